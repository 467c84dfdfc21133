"""Settings of a run: read once on the driver, never on executors."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Options:
    strict_grounding: bool = True
    max_input_chars: int = 0
    chunk_chars: int = 35_000
    max_new_tokens: int = 8192
    autofill_max_input_chars: int = 35_000
    autofill_max_new_tokens: int = 2048
    default_run_type: str = "program_extract"
    max_files: int = 5
    max_file_bytes: int = 25 * 1024 * 1024
    max_sheet_rows: int = 3000
    enable_ocr: bool = True
    pdf_force_ocr: bool = False
    pdf_min_chars_per_page: int = 40
    max_pdf_pages: int = 200
    #: Addresses are downloaded, and tools that are there read PDF and legacy Office files.
    enable_download: bool = True
    enable_tools: bool = True

    @classmethod
    def from_env(cls, env=None) -> Options:
        """Upper-case names of the fields; a malformed number is the default; 1, true, yes and on are true."""
        env = os.environ if env is None else env
        got = {}
        for f in fields(cls):
            raw = env.get(f.name.upper())
            if raw is None:
                continue
            kind = type(f.default)
            try:
                got[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw.strip())
            except ValueError:
                continue
        return cls(**got)
