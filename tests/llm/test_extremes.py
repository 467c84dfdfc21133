"""Empty tables, very long texts, wide alphabets, learned verdicts replayed, searches against exhaustive ones, the shared folder."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sijill.llm import common, simhash
from sijill.llm import decontaminate as dc
from sijill.llm import language_id as li
from sijill.llm import license_scan as ls
from sijill.llm import packing as pk
from sijill.llm import quality_classifier as qc
from sijill.llm import quality_rules as qr
from sijill.llm import secret_scan as ss
from sijill.llm import toxicity as tox

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, fold string"


def table(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", 0, "x", "y") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels", "benchmark")}


def operators(docs, labels, benchmark):
    return {
        "op1": lambda x: ls.license_scan(x),
        "op2": lambda x: dc.leaks(x, benchmark),
        "op3": lambda x: qr.judge(x, labels),
        "op4": lambda x: qc.resample(x, labels),
        "op5": lambda x: ss.scan(x, ss.fit(x)),
        "op6": lambda x: pk.pack_documents(x, pk.tokenizer_path()),
        "op7": lambda x: li.predict(x, li.fit(docs)),
        "op8": lambda x: simhash.near_duplicates(x),
        "op9": lambda x: tox.score(x, tox.fit(docs, labels)),
    }


def test_empty_tables_and_labels(spark, small):
    none = table(spark, []).limit(0)
    for name, f in operators(none, small["labels"].limit(0), small["benchmark"].limit(0)).items():
        assert f(none).count() == 0, name
    docs = table(spark, ["one two three", None, ""])
    assert {r["lang_pred"] for r in li.predict(docs, li.fit(none)).collect()} == {"und"}
    share = small["labels"].where(~tox.held_out()).agg(F.avg("toxic")).first()[0]
    assert [r["score"] for r in tox.score(docs, tox.fit(none, small["labels"])).collect()] == pytest.approx([share] * 3)
    assert {r["score"] < 1e-6 for r in tox.score(docs, tox.fit(docs, small["labels"].where("toxic = 0"))).collect()} == {True}
    assert simhash.keep_one(none).count() == 0 and dc.clean(none, small["benchmark"]).count() == 0


def test_long_texts_are_read_whole(spark, small):
    rng = random.Random(3)
    body = " ".join(f"w{rng.randrange(5000)}" for _ in range(170_000))
    tail = ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" under the mit license'
    item = small["benchmark"].where("length(text) > 60").orderBy("item_id").first()
    docs = table(spark, [body + " " + item["text"] + tail, "short"])
    f = operators(small["documents"], small["labels"], small["benchmark"])
    assert f["op1"](docs).where("doc_id = 0").first()["base_labels"] == "mit"
    assert f["op5"](docs).where("doc_id = 0").first()["n_assign"] == 1
    assert item["item_id"] in {r["item_id"] for r in f["op2"](docs).where("doc_id = 0").collect()}
    assert f["op3"](docs).where("doc_id = 0").first()["n_words"] > 170_000
    packed = f["op6"](docs).where("doc_id = 0")
    assert packed.agg(F.sum("length")).first()[0] == len(pk.Encoder(pk.tokenizer_path()).encode(body + " " + item["text"] + tail)) // 4 + 1
    assert f["op7"](docs).count() == f["op8"](docs).count() == f["op9"](docs).count() == f["op4"](docs).count() == 2


def test_a_wide_alphabet_takes_room_by_its_edges_and_parses_as_substring_search_does():
    rng = random.Random(5)
    wide = "".join(chr(0x4E00 + int(rng.paretovariate(0.5)) % 3000) for _ in range(6000))
    texts = {"wide": wide, "narrow": "".join(rng.choices("abcde ", k=3000))}
    p = li.Parser(texts)
    assert p.rows.entries.nbytes < 4_000_000
    segments = [wide[k : k + 40] for k in range(0, 800, 40)] + ["".join(rng.choices("abcdé ", k=30)) for _ in range(20)] + [wide[5:9] + "ab" + wide[70:75], "\ud800a"]

    def plain(text, s):
        n, start = 1, 0
        for end in range(1, len(s) + 1):
            if s[start:end] not in text:
                n, start = n + 1, end - 1 if s[end - 1] in text else end
        return n

    assert p.phrases(segments).tolist() == [[plain(texts[x], s) for x in p.languages] for s in segments]


def test_language_shares_come_from_all_over_a_document(spark):
    texts = ["head " * 400 + "middle " * 400 + "tail " * 400 for _ in range(30)]
    learned = li.fit(table(spark, [*texts, None, "", "123"]), max_docs=20, max_chars=2000)["en"]
    assert all(w in learned for w in ("head", "middle", "tail")) and len(learned) <= 2000
    tie = li.predict(table(spark, ["same words here"]), {"b": "same words here", "a": "same words here"}).first()
    assert tie["lang_pred"] == "a" and tie["score"] == pytest.approx(0.5)


def test_search_finds_what_exhaustive_alignment_finds(spark, small):
    docs = [(r["doc_id"], dc.words(r["text"])) for r in small["documents"].collect()]
    items = [(r["item_id"], dc.words(r["text"])) for r in small["benchmark"].collect()]
    want = {}
    for (d, w), (i, item) in itertools.product(docs, items):
        if w and item and len(set(w) & set(item)) >= len(set(item)) // 4:
            score, a, b = dc.smith_waterman(item, w)
            if score >= dc.THRESHOLD * dc.MATCH * len(item):
                want[d, i] = score / (dc.MATCH * len(item))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in dc.leaks(small["documents"], small["benchmark"]).collect()}
    assert got == pytest.approx(want) and want


def test_copies_whose_rare_words_were_changed_are_found(spark):
    rng = random.Random(8)
    common_words = [f"c{k}" for k in range(12)]
    item = [rng.choice(common_words) for _ in range(40)]
    for k in range(0, 40, 9):
        item[k] = f"rare{k}"
    changed = [w if not w.startswith("rare") else "other" for w in item]
    docs = table(spark, [" ".join(changed), *(" ".join(rng.choices(common_words, k=300)) for _ in range(40))])
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = dc.leaks(docs, bench).where("doc_id = 0").collect()
    assert len(got) == 1 and got[0]["score"] >= 0.5


def test_importance_weights_equal_plain_ones(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{int(rng.paretovariate(0.8)) % 60}" for _ in range(rng.randint(0, 60))) for _ in range(80)]
    docs = table(spark, [*texts, None, texts[0]])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int")
    got = sorted(qc.resample(docs, labels).collect(), key=lambda r: r["doc_id"])

    def grams(t):
        h = [__import__("zlib").crc32(w.encode()) for w in qc.WORD.findall((t or "").lower())]
        pair = [((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64 >> 40) % qc.BUCKETS for a, b in zip(h, h[1:], strict=False)]
        return [("u", x % qc.BUCKETS) for x in h] + [("b", x) for x in pair]

    raw, target = {}, {}
    for i, t in enumerate([*texts, None, texts[0]]):
        for g in grams(t):
            raw[g] = raw.get(g, 0) + 1
            if i < 60 and i % 3 == 0:
                target[g] = target.get(g, 0) + 1
    total = {(k, id(n)): sum(v for g, v in n.items() if g[0] == k) for k in "ub" for n in (raw, target)}
    p = lambda n, g: (n.get(g, 0) + 1) / (total[g[0], id(n)] + qc.BUCKETS)
    for r, t in zip(got, [*texts, None, texts[0]], strict=True):
        assert r["log_ratio"] == pytest.approx(sum(math.log(p(target, g) / p(raw, g)) for g in grams(t)), abs=1e-9)
    keys = sorted((r["key"] for r in got), reverse=True)
    assert {r["doc_id"] for r in got if r["kept"]} == {r["doc_id"] for r in got if r["key"] >= keys[math.ceil(qc.FRACTION * len(got)) - 1]}
    noise = np.array([r["key"] - r["log_ratio"] for r in got])
    assert len(set(noise.tolist())) == len(noise) and -2 < noise.mean() < 3


def test_ties_of_the_last_key_are_kept(spark):
    docs = table(spark, ["a b c"] * 10).withColumn("doc_id", F.lit(7).cast("long"))
    got = qc.resample(docs, spark.createDataFrame([(7, 1)], "doc_id long, quality int")).collect()
    assert len(got) == 10 and all(r["kept"] for r in got)


def test_learned_verdicts_equal_the_rules_replayed(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = qr.fit(docs, labels)
    kept = {r["doc_id"]: r["kept"] for r in qr.judge(docs, labels).collect()}
    stats = qr.statistics(docs).drop("row").select("*", qr.base_failed().alias("failed"), *(F.expr(e).alias(f"f_{f}") for f, e in qr.FEATURES.items())).collect()
    assert rules and len(stats) == len(kept)
    for r in stats:
        own = {f: r[f"f_{f}"] for f in qr.FEATURES}
        assert kept[r["doc_id"]] == (not r["failed"] and not any(rule.fires(own) for rule in rules))


def test_packing_is_certified_by_bounds(spark):
    rng = random.Random(9)
    docs = table(spark, [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(1, 300))) for _ in range(300)])
    pieces = pk.write_table(pk.tokenize(docs, pk.tokenizer_path(), 256), "pieces")
    packed = pk.pack(pieces, 256, group=50)
    rows = packed.collect()
    assert all(r["certified"] == (r["bins"] == r["bound"]) for r in rows) and any(r["certified"] for r in rows)
    assert pieces.select("place").distinct().count() == pieces.count()
    told = pk.certificate(packed, 256).first()
    assert told["sequences"] == len({r["sequence_id"] for r in rows}) >= told["least"] == -(-sum(r["length"] for r in rows) // 256)


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[3,2,1000]", "yarn"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    from types import SimpleNamespace as Fake

    unset = Fake(sc=lambda: Fake(getCheckpointDir=lambda: Fake(isDefined=lambda: False)))
    session = Fake(conf=Fake(get=lambda *_: None), sparkContext=Fake(master=master, _jsc=unset))
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(session)


def test_secrets_of_a_hot_id_do_not_fill_the_sample(spark):
    docs = table(spark, ["plain words only"] * 50).withColumn("doc_id", F.lit(1).cast("long"))
    model = ss.fit(docs.unionByName(table(spark, [None, "other words"])), max_docs=2)
    assert model.threshold > 0


def test_a_sieve_holds_back_what_is_not_in_it(spark):
    rng = random.Random(4)
    inside = [rng.getrandbits(64) - 2**63 for _ in range(500)] + [-1, 0, 2**63 - 1, -(2**63)]
    other = [rng.getrandbits(64) - 2**63 for _ in range(2000)]
    s = common.Sieve(spark.createDataFrame([(x,) for x in inside], "k long"), "k", bits=1 << 16)
    let = {r["k"] for r in s.marked(spark.createDataFrame([(x,) for x in inside + other], "k long"), "k", "in").where("in").collect()}
    assert set(inside) <= let and len(let & set(other)) < 100
    assert common.Sieve(spark.range(0), "id").marked(spark.range(9), "id", "in").where("in").count() == 0


def test_similar_links_are_the_same_in_blocks(monkeypatch):
    rng = random.Random(7)
    base = [rng.sample(range(10**6), 60) for _ in range(12)]
    members = []
    for k in range(90):
        own = list(base[k % 12])
        own[: rng.randint(0, 9)] = rng.sample(range(10**6, 2 * 10**6), rng.randint(0, 9))
        members.append((k, np.unique(np.array(own, dtype=np.uint64)).tobytes()))

    def groups(links):
        up = {k: k for k in range(90)}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            up[top(a)] = top(b)
        return sorted(sorted(k for k in up if top(k) == r) for r in {top(k) for k in up})

    whole, cut = simhash.similar_links(members), simhash.similar_links(members[:40], members[40:])
    monkeypatch.setattr(simhash, "HASHES", 150)
    assert groups(simhash.similar_links(members)) == groups(whole) and groups(simhash.similar_links(members[:40], members[40:])) == groups(cut)
    assert 12 <= len(groups(whole)) < 90


def test_base_queries_equal_sql(spark):
    import duckdb

    from sijill import llm

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    for name in ("secret_counts", "quality_statistics"):
        got = llm.queries()[name](spark, "/root/testdata/sf0.001")
        want = con.execute(llm.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
