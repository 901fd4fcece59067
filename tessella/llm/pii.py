"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Kinds in their listed order: email, ip, card, phone (the base kinds: every validated match stays), then iban, ssn,
local_phone, secret (keys and tokens) and private_key (PEM blocks), which stay when their score reaches KEEP and no base
span overlaps them. A secret is a long run of letters and digits: one with the prefix of a known issuer scores enough
alone, others only beside a word such as token or password. Matches are leftmost and
non-overlapping within a kind; one that fails its validator is dropped and not retried. An iban's pattern gives its start
only: its end is where the country's length, the whole run of groups or, for countries not listed, the longest run that
ends at a border passes mod 97, so that words behind it are not taken in. Expressions only: a text's matches
are located by splitting it with the pattern and adding up lengths in code points. The patterns have no nested
backtracking: possessive quantifiers and look-behind keep them linear in the text.

Defined results: null and empty texts have no spans, and mask gives an empty text; repeated rows are scanned each, also
where they share a doc_id or have none; an empty table gives an empty result; other columns are ignored; texts are scanned
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "local_phone", "secret", "private_key"]
BASE = KINDS[:4]
#: \G: the end of the match before; a match may begin there though a character of the class stands in front.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_+-])[A-Za-z0-9_+-]{20,}+",
    "private_key": r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[^-]*+(?:-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----)?",
}
#: Prefixes that issuers of keys and tokens have published.
ISSUED = r"^(?:AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|sk_live_|sk_test_|rk_live_|xox[abprs]-|eyJ|npm_|pypi-|SG\.)"
#: Cheap tests that a text can hold the kind at all.
HINTS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-", "private_key": "-----BEGIN "}
DIGITS = {"ip", "card", "phone", "iban", "ssn", "local_phone", "secret"}
CONTEXT = {
    "email": r"e-?mail|contact|write to|mailto",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|visa|master|amex|credit|debit|payment",
    "phone": r"phone|tel\b|call|mobile|fax|contact",
    "iban": r"iban|account|bank|konto|cuenta|compte",
    "ssn": r"\bssn\b|social|security|insurance",
    "local_phone": r"phone|tel\b|call|mobile|fax|contact",
    "secret": r"token|secret|passw|\bpwd\b|key\b|\bauth|bearer|credential",
    "private_key": r"key|secret|cert",
}
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "local_phone": 0.3, "secret": 0.3, "private_key": 0.9}
BONUS, KEEP, NEAR, KNOWN = 0.2, 0.5, 48, 0.4


#: Characters of an account code by country.
IBAN = {
    n: countries.split()
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}


def _accounts(heads: Column, text: Column) -> Column:
    """Those of the heads (start, hit) that begin an account code, with the code as hit; leftmost, non-overlapping."""

    def code(m: Column) -> Column:
        seen = F.substring(text, m["start"] + 1, 68)  # 34 characters with a blank before each but the first, and the one after
        known = F.coalesce(*[F.when(F.substring(m["hit"], 1, 2).isin(c), n) for n, c in IBAN.items()], F.lit(0))
        runs = F.filter(F.array(*[F.regexp_extract(seen, rf"^[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])", 0) for n in range(34, 14, -1)]), lambda r: r != "")
        size = lambda r: F.length(F.replace(r, F.lit(" "), F.lit("")))
        whole = F.regexp_extract(seen, r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", 0)
        able = F.concat(F.filter(runs, lambda r: size(r) == known), F.filter(runs, lambda r: (size(r) != known) & ((known == 0) | (r == whole))))
        return F.struct(m["start"].alias("start"), F.get(F.filter(able, lambda r: mod97(F.replace(r, F.lit(" "), F.lit("")))), F.lit(0)).alias("hit"))

    found = F.filter(F.transform(heads, code), lambda m: m["hit"].isNotNull())
    start = F.expr("struct(0 as at, cast(array() as array<struct<start:int,hit:string>>) as found)")
    add = lambda a, m: F.when(m["start"] < a["at"], a).otherwise(F.struct((m["start"] + F.length(m["hit"])).alias("at"), F.concat(a["found"], F.array(m)).alias("found")))
    return F.aggregate(found, start, add, lambda a: a["found"])


def _matches(text: Column, kind: str) -> Column:
    """Array of (start, hit); start in code points."""
    pairs = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("hit"))
    start = F.expr("struct(0 as at, cast(array() as array<struct<start:int,hit:string>>) as found)")

    def add(a: Column, p: Column) -> Column:
        at = a["at"] + F.length(p["gap"])
        return F.when(p["hit"].isNull(), a).otherwise(F.struct((at + F.length(p["hit"])).alias("at"), F.concat(a["found"], F.array(F.struct(at.alias("start"), p["hit"].alias("hit")))).alias("found")))

    return F.aggregate(pairs, start, add, lambda a: a["found"])


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code without blanks leaves 1 under ISO 7064 mod 97-10."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))

    def add(r: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":  # leading zeros do not count
        return F.forall(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "ssn":
        return ~hit.rlike("^(?:000|666|9..)|-00-|-0000$")
    if kind == "secret":  # random characters: letters and digits, and many different ones
        return hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(hit, ""))) >= 10)
    return F.lit(True)


def _found(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, score) of the matches that pass; score at least KEEP for the kinds added to the base."""
    far = F.length(F.lit(""))

    def score(hit: Column, near: Column) -> Column:
        known = F.when(hit.rlike(ISSUED), KNOWN).otherwise(0.0) if kind == "secret" else F.lit(0.0)
        return F.round(F.when(near, SCORES[kind] + BONUS).otherwise(F.lit(SCORES[kind])) + known, 2)

    def scored(m: Column) -> Column:
        start, end = m["start"], m["start"] + F.length(m["hit"])
        begin = F.greatest(start - NEAR, far)
        near = F.lower(F.substring(text, begin + 1, end - begin + NEAR)).rlike(CONTEXT[kind])
        return F.struct(F.lit(KINDS.index(kind)).alias("rank"), start.alias("start"), end.alias("end"), score(m["hit"], near).alias("score"))

    matches = _accounts(_matches(text, kind), text) if kind == "iban" else _matches(text, kind)
    found = F.transform(F.filter(matches, lambda m: _valid(kind, m["hit"])), scored)
    if kind not in BASE:
        found = F.filter(found, lambda s: s["score"] >= KEEP)
    able = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
    if kind in DIGITS:
        able = able & F.col("_digits")
    return F.when(able, found).otherwise(F.expr("cast(array() as array<struct<rank:int,start:int,end:int,score:double>>)"))


def _scanned(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, _text (null: empty), base and spans of each row."""
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_digits", F.col("_text").rlike("[0-9]"))
    rows = rows.select("doc_id", "_text", F.concat(*[_found(F.col("_text"), k) for k in BASE]).alias("_base"), F.concat(*[_found(F.col("_text"), k) for k in KINDS[4:]]).alias("_more"))
    free = F.filter("_more", lambda m: ~F.exists(F.col("_base"), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return rows.select("doc_id", "_text", F.array_sort("_base", order).alias("base"), F.array_sort(F.concat("_base", free), order).alias("spans"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, base and spans: arrays of (rank in KINDS, start, end, score) by start, then kind."""
    return _scanned(docs, doc_id, text).drop("_text")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.0) -> DataFrame:
    """doc_id and the text with every span of score least or more replaced by its kind in angle brackets; of overlapping spans the first counts."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    start = F.expr("struct(cast(array() as array<string>) as parts, 0 as at)")
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(F.concat(a["parts"], F.array(F.substring(F.col("_text"), a["at"] + 1, s["start"] - a["at"]), F.get(names, s["rank"]))).alias("parts"), s["end"].alias("at")))
    rows = _scanned(docs, doc_id, text).select("doc_id", "_text", F.filter("spans", lambda s: s["score"] >= least).alias("spans"))
    return rows.select("doc_id", F.aggregate("spans", start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(F.col("_text"), a["at"] + 1, F.length("_text")))).alias("text"))
