"""Fixed vocabularies of contract documents, and the column functions that map names and codes to them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchment.functions.text import is_blank, nvl, trim

# Fixed values.
FILE_ORDER = ["NTT", "SCT", "SCC", "GCT", "FT", "AA", "GCC", "SL", "PRE"]
TEMPLATE_KEYS = ["NTT", "SCT", "SCC"]
FILE_TITLES = {"NTT": "Notes to Tenderers", "SCT": "Special Conditions of Tender", "SCC": "Special Conditions of Contract"}
ACTIONS = ["fill", "choice", "rewrite", "delete", "notused"]
TYPE_PRIORITY = ["f2-iii", "f2-iv", "f2-i", "f2-vi", "f2-viii", "f2-ix", "f2-v", "f2-vii", "f2-ii"]
TYPE_GROUP = {
    "f2-iii": "reference",
    "f2-iv": "reference",
    "f2-i": "conflict",
    "f2-vi": "conflict",
    "f2-viii": "conflict",
    "f2-v": "language",
    "f2-ix": "language",
    "f2-ii": "risk",
    "f2-vii": "risk",
}
GROUPS = ["reference", "conflict", "language", "risk"]
DEFAULT_BUCKETS = {"reference": "missing", "language": "grammar", "conflict": "particulars"}
# key, label, action, options, kind, files
BASE_VARIABLES = [
    ("contractTitle", "Contract No. and Title", "fill", None, None, "NTT,SCT,SCC"),
    ("worksType", "Type of Works", "fill", None, None, "SCC"),
    ("fundingArrangement", "Tender A / B Funding Arrangement", "choice", ["Tender A", "Tender B"], None, "SCC"),
    ("billNos", "BQ Bill Items", "fill", None, "list", "NTT,SCC"),
    ("subcontractors", "Nominated Sub-contractors", "fill", None, "list", "SCC"),
    ("twoEnvelopeSystem", "Two-Envelope Tendering System", "choice", ["是", "否", "待确认"], None, "NTT"),
    ("foundationIncluded", "Combined Contract with Foundation Works", "choice", ["是", "否", "待确认"], None, "SCC"),
    ("contractPeriod39Months", "Contract Period 39 Months or More", "choice", ["是", "否", "待确认"], None, "SCC"),
]
# Lines that may settle a base variable hold one of these.
BASE_KEYWORDS = [
    "contract no", "contract title", "tender a", "tender b", "funding arrangement",
    "bill ", "bq", "bill schedule", "preliminar", "preamble",
    "sub-contractor", "subcontractor", "specialist", "nominated", "trade",
    "foundation", "combined contract", "merge",
    "month", "39", "threshold", "period", "programme",
    "two-envelope", "envelope", "l10pro", "hard copy", "hardcopy", "tendering method",
    "electronic dissemination", "tender preparation", "tender return",
]
# Places of a template near which a decision is due.
DECISION_MARKERS = [
    "Guidance", "guidance", "NOTE:", "Option A", "Option B",
    "Not used", "not used", "Delete", "delete", "amend", "Amend",
    "alternative", "Alternat", "For use in", "For use where",
    "two-envelope", "envelope tendering", "e-Tender", "e-tender",
    "precast", "Precast", "nominated", "Nominated",
]


def _first(name: Column, pairs: list[tuple[str, str]], otherwise: Column) -> Column:
    out = None
    for part, key in pairs:
        out = F.when(F.contains(name, F.lit(part)), key) if out is None else out.when(F.contains(name, F.lit(part)), key)
    return out.otherwise(otherwise)


def match_file_key(file_name: Column) -> Column:
    """The first known key that the name holds, wherever it stands; null if none."""
    pairs = [(k, k) for k in FILE_ORDER] + [("TENDERER", "NTT"), ("SPECIFICATION", "SL"), ("PRELIMINAR", "PRE")]
    return _first(F.upper(nvl(file_name)), pairs, F.lit(None).cast("string"))


def match_template_key(file_name: Column) -> Column:
    # Parts of names and their keys, in this order.
    pairs = [(k.lower(), k) for k in TEMPLATE_KEYS]
    pairs += [("tenderers", "NTT"), ("notes", "NTT"), ("special condition of tender", "SCT"), ("tender condition", "SCT"), ("special condition", "SCC"), ("contract", "SCC")]
    return _first(F.lower(nvl(file_name)), pairs, F.lit("NTT"))


def csv(c: Column) -> Column:
    """The trimmed entries of a comma list."""
    return F.transform(F.split(nvl(c), ","), trim)


def group_of(types: Column) -> Column:
    present, out = csv(types), None
    for t in TYPE_PRIORITY:
        hit = F.array_contains(present, t)
        out = F.when(hit, TYPE_GROUP[t]) if out is None else out.when(hit, TYPE_GROUP[t])
    return out.otherwise("risk")


def scope(c: Column) -> Column:
    return F.when(F.lower(nvl(c)) == "intra", "intra").otherwise("inter")


def severity(c: Column) -> Column:
    return F.when(F.lower(nvl(c)).isin("high", "medium", "low"), F.lower(c)).otherwise("medium")


def file_key(c: Column, allowed: list[str] = FILE_ORDER) -> Column:
    """A known key in capitals; null for anything else, blanks around a key included."""
    return F.when(F.upper(c).isin(allowed), F.upper(c))


def status(c: Column) -> Column:
    return F.when(c.isin("Handled", "Assigned"), c).otherwise("Open")


def default_bucket(group: Column, bucket: Column) -> Column:
    out = F.when(~is_blank(bucket), trim(bucket))
    for g, b in DEFAULT_BUCKETS.items():
        out = out.when(group == g, b)
    return out.otherwise("scope")


def document_type(content_type: Column, file_name: Column) -> Column:
    kind, name = F.lower(nvl(content_type)), F.lower(nvl(file_name))
    mail = F.contains(kind, F.lit("message")) | F.contains(kind, F.lit("rfc822")) | name.rlike(r"\.(eml|msg)$")
    word = F.contains(kind, F.lit("word")) | name.rlike(r"\.docx?$")
    return F.when(mail, "邮件").when(F.contains(kind, F.lit("pdf")) | F.endswith(name, F.lit(".pdf")), "PDF").when(word, "Word").otherwise("文本")


def status_tag(c: Column) -> Column:
    return F.when(c == "PARSED", "ok").when(c == "FAILED", "danger").otherwise("info")


def localized(hans: Column, hant: Column, en: Column) -> Column:
    return F.struct(nvl(hans).alias("zhHans"), F.coalesce(F.nullif(hant, F.lit("")), nvl(hans)).alias("zhHant"), nvl(en).alias("en"))


def pick(text: Column, lang: str) -> Column:
    own = {"en": text["en"], "zh-hant": text["zhHant"]}.get(lang.lower(), text["zhHans"])
    return F.coalesce(F.nullif(own, F.lit("")), text["zhHans"])


def language_name(lang: Column) -> Column:
    return F.when(F.lower(lang) == "en", "English").when(F.lower(lang) == "zh-hant", "繁體中文").otherwise("简体中文")


# What a scope is called.
SCOPES = {"tender": "Tender documents only / 仅招标文件", "contract": "Conditions of Contract only / 仅合约条件"}


def scope_label(scope: Column) -> Column:
    out = F.when(scope == "tender", SCOPES["tender"]).when(scope == "contract", SCOPES["contract"])
    return out.otherwise("Selected package conditions / 选定合约条件")


def file_title(key: Column) -> Column:
    out = F.when(key.isNull(), "")
    for k, title in FILE_TITLES.items():
        out = out.when(key == k, title)
    return out.otherwise(key)


def affects_file(own: Column, affects: Column, key: Column) -> Column:
    return F.coalesce(own == key, F.lit(False)) | F.array_contains(csv(affects), key)


def sanitize_affects(c: Column) -> Column:
    kept = F.array_distinct(F.filter(F.transform(csv(c), lambda x: F.upper(x)), lambda x: x.isin(TEMPLATE_KEYS)))
    return F.nullif(F.array_join(kept, ","), F.lit(""))


# How a model words a choice. How it is compared (the whole, its beginning, any part), with what, and the option.
WORDINGS = [
    ("is", ["yes", "y", "true", "1"], "是"),
    ("is", ["no", "n", "false", "0"], "否"),
    ("begins", ["pending"], "待确认"),
    ("holds", ["待确认", "待確認", "tbd", "unknown"], "待确认"),
    ("begins", ["tender a"], "Tender A"),
    ("begins", ["tender b"], "Tender B"),
    ("holds", ["l10pro", "l10 pro"], "L10Pro"),
    ("holds", ["hardcopy", "hard copy"], "hardcopy"),
]


def normalize_choice(value: Column, options: Column) -> Column:
    """A model's wording of a choice as the option that it means, by the first of WORDINGS; an option itself, and other
    wording, stays."""
    said, compare = F.lower(trim(value)), {"is": lambda a, b: a == b, "begins": F.startswith, "holds": F.contains}
    meant = F.coalesce(*[F.when(reduce(or_, [compare[how](said, F.lit(w)) for w in words]), option) for how, words, option in WORDINGS], value)
    own = F.array_contains(options, trim(value))
    return F.when(own, trim(value)).when(F.size(options) > 0, meant).otherwise(value)


def choice_of(value: Column, options: Column) -> Column:
    """The option that a value stands for: itself, the first that it contains, else the first of all; null for no value."""
    held = F.filter(options, lambda o: F.contains(F.lower(value), F.lower(o)))
    return F.when(is_blank(value), F.lit(None).cast("string")).when(F.array_contains(options, value), value).when(F.size(held) > 0, F.get(held, F.lit(0))).otherwise(F.get(options, F.lit(0)))


def normalize_list(value: Column) -> Column:
    """Lines of a value as a JSON array; an array stays as it is."""
    v = trim(nvl(value))
    lines = F.regexp_replace(F.regexp_replace(v, r"\\r\\n|\\n|\\r", "\n"), r"\r\n", "\n")
    return F.when(v == "", "[]").when(F.startswith(v, F.lit("[")), value).otherwise(F.to_json(F.filter(F.transform(F.split(lines, "\n"), trim), lambda x: x != "")))
