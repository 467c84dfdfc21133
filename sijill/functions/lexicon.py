"""Vocabulary that decides results, and its normal form. Lexicons are normalised once, on the driver."""

from __future__ import annotations

import re
import unicodedata

# ---- fixed values -------------------------------------------------------------------------------------------------
EASTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
WESTERN_DIGITS = "01234567890123456789"
TATWEEL = "ـ"
DIACRITIC_RANGES = ((0x610, 0x61A), (0x64B, 0x65F), (0x670, 0x670), (0x6D6, 0x6ED))
BIDI_CONTROLS = "\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\ufeff"
BULLETS = "*•-–— "
TITLE_EDGES = " :：.-–—"

FIELDS = ("type", "name", "year", "description", "beneficiaries_count", "budget", "beneficiary_value", "target_audience", "delivery_method", "notes")
NULL_WORDS = ("", "null", "none", "n/a", "na", "-", "—", "غير متوفر", "غير محدد", "لا يوجد", "لا توجد")
NUMBER = r"\d{1,3}(?:[, ]\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
MULTIPLIERS = (("مليار|billion|bn", 1e9), ("مليون|million|mn|m", 1e6), ("ألف|الف|آلاف|الاف|thousand|k", 1e3))
GENERIC_PREFIX = r"^(?:ال)?(?:برنامج|مشروع|المشروع|مبادرة|المبادرة|نشاط|النشاط)\s*[:\-–—]?\s*"
LIST_JOINER = "، "

FIELD_HINTS = ("عدد المستفيدين", "عدد المستفيدات", "المستفيدين", "المستفيدات", "الفئة المستهدفة", "مكان التنفيذ", "آلية التنفيذ", "طريقة التنفيذ", "الميزانية", "الموازنة", "التكلفة", "عدد المتطوعين", "ساعات التطوع", "عدد الهدايا", "عدد الوجبات", "عدد الحملات", "ملاحظات", "ملاحظة")
BENEFICIARY_LABELS = ("عدد المستفيدين", "عدد المستفيدات", "إجمالي المستفيدين", "اجمالي المستفيدين", "المستفيدين", "المستفيدات")
BUDGET_LABELS = ("الميزانية", "الموازنة", "التكلفة", "قيمة المشروع", "تكلفة المشروع", "إجمالي التكلفة", "اجمالي التكلفة", "budget", "cost")
TARGET_LABELS = ("الفئة المستهدفة", "الفئات المستهدفة", "الفئة المستفيدة")
DELIVERY_LABELS = ("مكان التنفيذ", "موقع التنفيذ", "آلية التنفيذ", "طريقة التنفيذ")
NOTES_LABELS = ("ملاحظات", "ملاحظة", "ملاحظات المشروع", "ملاحظات البرنامج", "notes")

ORDINAL_RANK = {"اولا": 1, "اول": 1, "ثانيا": 2, "ثالثا": 3, "رابعا": 4, "خامسا": 5, "سادسا": 6, "سابعا": 7, "ثامنا": 8, "تاسعا": 9, "عاشرا": 10}
PROJECT_NOUNS = ("مبادرة", "مشروع", "المشروع", "مسابقة", "دورة", "ملتقى", "الدليل")
PROGRAM_NOUNS = ("برنامج", "البرنامج", "برامج")
STRONG_PROJECT_NOUNS = ("مشروع", "المشروع", "مبادرة", "المبادرة")
FLEXIBLE_NOUNS = ("مسابقة", "دورة", "ملتقى", "دليل", "الدليل", "حملة", "خدمة", "منصة", "مسار")
NUMBERED_NOUNS = ("مبادرة", "مشروع", "برنامج", "مسابقة", "دورة", "ملتقى", "الدليل")
PROGRAM_FAMILY, PROGRAM_ONE, CONTAINERS = "برامج", "برنامج", ("منصة", "مسار", "حزمة")
GENERIC_HEADINGS = ("البرامج والمبادرات", "برامج ومبادرات", "برامج ومشاريع", "البرامج والمشاريع", "البرامج التعليمية", "البرامج", "أبرز البرامج", "ابرز البرامج", "قائمة البرامج", "برامجنا", "key programs", "featured programs", "programs")
PROJECT_LISTS = ("أبرز المشاريع", "ابرز المشاريع", "المشاريع", "قائمة المشاريع", "المبادرات", "أبرز المبادرات", "ابرز المبادرات", "projects", "initiatives")
PROGRAM_LISTS = ("أبرز البرامج", "ابرز البرامج", "قائمة البرامج", "برامجنا", "featured programs", "key programs", "program list")
ACTIVITY_LISTS = ("أبرز الأنشطة", "ابرز الانشطة", "الأنشطة", "الفعاليات", "activities", "events")
PROSE_OPENERS = ("برنامج يهدف", "برنامج يعنى", "برنامج يسعى", "برنامج لتعليم", "برنامج مخصص", "مشروع مخصص", "مشروع يهدف", "مشروع مفتتح", "مبادرة تهدف", "دورة تدريبية مقدمة", "ملتقى يهدف", "حلق تعنى", "حلقة مخصصة", "حلقات تعتني", "منصة تعليمية", "program aims", "program designed", "project aims", "initiative aims")
CONNECTORS = ("ومنها", "ومن ذلك", "وذلك", "حيث", "كما", "قال", "قال رسول", "رواه", "أخرجه", "نسعى", "تسعى", "يهدف", "تهدف", "تقديم", "توزيع", "زيارة", "استقبال", "توجيه وإرشاد", "تأهيل وتدريب", "في إطار", "ضمن إطار", "انطلاقا", "therefore", "where", "aims to", "the program aims")
SECTION_STARTS = ("منجزات", "إنجازات", "انجازات", "نتائج", "الموارد البشرية", "الحوكمة", "التقرير المالي", "الشراكات", "الاستدامة المالية", "مجلس الادارة", "مؤشرات الاداء", "الهيكل التنظيمي", "فروع الجمعية", "الاتصال", "تقنية المعلومات", "من نحن", "رؤية ورسالة", "الادارات النسائية", "human resources", "governance", "financial report", "partnerships", "contents")
PROSE_VERBS = ("يهدف", "تهدف", "يعنى", "تعنى", "يسعى", "تسعى", "يقدم", "تقدم", "يضم", "تضم", "يحتوي", "تحتوي", "مخصص", "مخصصة", "مقدمة", "مقدم", "لتعليم", "لتحسين", "لتأهيل", "لتقديم", "لاعداد", "لإعداد")
COURSE_OPENER = "دورة تدريبية"
NOT_TITLES = ("ملتقى يهدف", "دورة تدريبية", "دوره تدريبيه")
CONTINUATIONS = ("وذلك", "حيث", "ضمن", "حتى", "مع")
TOTALS = ("الإجمالي", "الإجاملي", "اجمالي", "اجاملي", "المجموع", "total")
NUMBER_OF = "عدد"
PLACES_WON = ("المركز الاول", "المركز الثاني", "المركز الثالث")
REPORT_MARKER, PAGE_MARKER = "التقرير", r"^ف\s*\d+$"
ANNUAL_REPORT = ("التقرير السنوي", "annual report")
BANK_STARTS = ("sa", "حساب", "مصرف", "بنك")
STOP_LEXEMES = ("برنامج", "البرنامج", "مشروع", "المشروع", "مبادرة", "المبادرة", "برامج", "مشاريع", "مبادرات", "من", "في", "على", "الى", "إلى", "عن")
PLACE_MARKERS = ("مقر", "موقع", "مكان", "فندق", "الفنادق", "مستشفى", "مسجد", "المسجد", "مصلى", "مصليات", "المصليات", "ساحات", "الساحات", "المنطقة", "غرفة", "قاعة", "مركز", "المركز", "المطار", "المطارات", "المحطة", "المحطات", "عن بعد", "الحملات", "التخصصي")
AUDIENCE_MARKERS = ("ضيوف", "ضيفات", "الحاجات", "الحجاج", "المعتمرات", "الزائرات", "الرجال", "النساء", "أطفال", "اطفال", "فتيات", "مشرفات", "المريضات", "المر يضات", "مر يضات", "العاملون", "المهتمون", "المتطوعات", "المتطوعين", "حملات حجاج", "حجاج الداخل", "الخارج", "الخار ج", "العرب")
#: Words broken by character recognition, with a blank for any white space, and their repairs; the last ones as whole words.
BROKEN_WORDS = (("توز يع", "توزيع"), ("ز يارة", "زيارة"), ("تعز يز", "تعزيز"), ("تدر يب", "تدريب"), ("المعتمر ين", "المعتمرين"), ("الخار ج", "الخارج"), ("المركز ية", "المركزية"), ("الإنجليز ية", "الإنجليزية"), ("التذكار ية", "التذكارية"), ("الكر يم", "الكريم"), ("المر يضات", "المريضات"), ("مر يضات", "مريضات"), ("نم اذج", "نماذج"), ("فر ق", "فرق"), ("ب فاعلية", "بفاعلية"))
BROKEN_WHOLE_WORDS = (("التلقني", "التلقين"), ("الصغري", "الصغير"), ("القرآين", "القرآني"), ("تحسني", "تحسين"), ("غري", "غير"))
BROKEN_LITERALS = (("اءّالقر", "القراء"),)
BROKEN_MARKS = (("أرًزا", "أرزًا"), ("دعًما", "دعمًا"))
LIST_VERBS = ("تتضمن", "شملت")
HEADQUARTERS = "مقر الجمعية"
AFTER_HEADQUARTERS = ("الفنادق", "الحملات", "حملات", "مسجد", "مصلى", "مصليات", "مستشفى", "غرفة", "ساحات", "المنطقة")
#: What callers read in notes and warnings.
SAID_MANY = "تم العثور على %s برامج/مشاريع؛ تمت تعبئة النموذج بـ «%s». عناصر أخرى: %s"
SAID_NONE = "لم يتم العثور على برنامج/مشروع مؤكد في النص المستخرج؛ لم تتم تعبئة أي قيمة تخمينية."
SAID_CUT = "استجابة النموذج كانت طويلة وتم قطعها؛ راجع الحقول قبل الحفظ."
SAID_LONG = "المحتوى طويل (%s حرف)؛ تمت قراءة أول %s حرف فقط."
SAID_UNREAD = "تعذر قراءة الملف %s: %s"
SAID_EMPTY = "لم يُستخرج أي نص من الملف %s."
EXTENSIONS = {".pdf": "pdf", ".docx": "docx", ".docm": "docx", ".doc": "doc", ".xlsx": "xlsx", ".xlsm": "xlsx", ".xls": "xls", ".csv": "csv", ".tsv": "tsv", ".txt": "text", ".md": "text", ".json": "json", ".pptx": "pptx", ".ppt": "ppt"}
MIME_TYPES = {"application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/msword": "doc", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/vnd.ms-excel": "xls", "text/csv": "csv", "text/tab-separated-values": "tsv", "text/plain": "text", "text/markdown": "text", "application/json": "json", "text/json": "json"}
SUPPORTED = "PDF, Word (DOCX/DOC), Excel (XLSX/XLS), CSV/TSV, TXT/MD, JSON"
RUN_TYPES = ("program_autofill", "program_extract", "extract_text")
# -------------------------------------------------------------------------------------------------------------------

DIACRITICS = "".join(chr(c) for a, b in DIACRITIC_RANGES for c in range(a, b + 1))
#: For translate(): what is folded or, beyond the length of FOLDED, deleted.
FOLD_FROM = EASTERN_DIGITS + "أإآى" + TATWEEL + DIACRITICS
FOLD_TO = WESTERN_DIGITS + "اااي"
_TABLE = {ord(c): FOLD_TO[k] if k < len(FOLD_TO) else None for k, c in enumerate(FOLD_FROM)}
OUTSIDE = r"[^0-9A-Za-z؀-ۿ]+"


def normal(text: str) -> str:
    """The normal form of a word or phrase of a lexicon, as functions.text.norm() has it of a column."""
    return re.sub(OUTSIDE, " ", unicodedata.normalize("NFKC", text).translate(_TABLE).lower()).strip()


def alternatives(phrases) -> str:
    """A regular expression of the phrases' normal forms, which hold no special characters."""
    return "(?:" + "|".join(dict.fromkeys(normal(p) for p in phrases)) + ")"
