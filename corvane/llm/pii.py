"""Personal data: expressions propose spans, checksums confirm them, context words adjust the score.

Everything is a DataFrame expression.  A kind's matches are taken with
``regexp_extract_all``; their places follow from the lengths of the pieces that
``split`` leaves between them.  Runs are possessive and start where a run starts
(or where the last match ended), so no text makes the search quadratic, while the
leftmost non-overlapping matches stay those of the plain expressions:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)   parts at most 255
    card   [0-9]([\\x20-]?[0-9])+                    16 to 19 digits passing Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9]              8 to 15 digits

An IBAN's expression takes only its first four characters, so that every start is seen;
its end follows from the country's length, or, for a code that is not in the registry, is the
last of the ends at 15 to 34 characters at which mod-97 holds.

The first four are kept whenever their check passes.  Further kinds (iban by mod-97,
ssn, key) are kept from a score of 0.5: an expression alone gives 0.3, a
checksum or a fixed prefix 0.6, context words within 50 code points add 0.3.

Long texts with many matches stay near linear: ends come from a scan by doubling (log n passes over
the lengths), and contexts and pieces are cut from chunks of ``CHUNK`` code points, never from the
start of the text.  Overlaps are united by a running maximum from the same scan.

Cases: null text is empty and has no spans; a null id is kept; repeated rows give
repeated results; an empty table gives an empty result; further columns do not
matter.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import unpack_row, with_row

CONTEXT = 50
THRESHOLD = 0.5
CHUNK = 512
_LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a cheap condition on `text` without which nothing can match
    context: str
    confirmed: float  # the score of a match whose check passed
    base: bool


KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')", "e-?mail|mail|contact|write", 0.9, True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "text rlike '[0-9][.][0-9]'", "ip|address|host|server|login", 0.6, True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){15,}+", "text rlike '[0-9][0-9 -]{15}'", "card|credit|debit|visa|payment", 0.9, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')", "phone|call|tel|mobile|fax", 0.6, True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})", "text rlike '[A-Z]{2}[0-9]{2}'", "iban|bank|account|transfer", 0.6, False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "text rlike '[0-9]-[0-9]'", "ssn|social|security", 0.3, False),
    Kind("key", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])", "contains(text, 'AKIA')", "key|secret|token|access", 0.6, False),
)

#: The lengths of the IBAN registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    reverse = F.reverse(digits)
    value = lambda i: F.substring(reverse, i, 1).cast("int")
    doubled = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i)))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's check digits hold."""
    bare = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    code = lambda i: F.ascii(F.substring(moved, i, 1))
    step = lambda acc, c: F.when(c >= 65, acc * 100 + (c - 55)).otherwise(acc * 10 + (c - 48)) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), lambda acc, i: step(acc, code(i))) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return F.forall(F.split(match, "[.]"), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: a lambda binds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, join) -> Column:
    """Running ``join`` of an array: log n passes, each a whole new array, so nothing is appended."""
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int") - 1, F.lit(0)))
    powers = F.transform(steps, lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(powers, values, lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= k, join(x, F.get(acc, i - k))).otherwise(x)))


def _cut(chunks: Column, start: Column, length: Column) -> Column:
    """``length`` code points from ``start`` (0-based) of a text in chunks; linear in what is cut."""
    first = F.floor(start / CHUNK).cast("int")
    many = F.floor((start % CHUNK + length) / CHUNK).cast("int") + 1
    within = F.slice(chunks, first + 1, F.greatest(F.least(many, F.size(chunks) - first), F.lit(0)))
    return F.when((length <= 0) | (first >= F.size(chunks)), F.lit("")).otherwise(F.array_join(within, "").substr((start % CHUNK + 1).cast("int"), length.cast("int")))


def _ibans(heads: Column, chunks: Column) -> Column:
    """Valid IBANs, left to right without overlaps, from the places of their first four characters."""
    body = lambda codes, n: rf"(?:{codes})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}"
    of_length = "|".join(body(codes.replace(" ", "|"), n) for n, codes in IBAN_LENGTHS.items())
    codes = "|".join(" ".join(IBAN_LENGTHS.values()).split(" "))

    def whole(s: Column) -> Column:
        def look(ahead: Column) -> Column:
            ends = F.array(*[F.regexp_extract(ahead, rf"^{body('[A-Z]{2}', n)}(?![A-Za-z0-9])", 0) for n in range(34, 14, -1)])
            ends = F.when(ahead.rlike(f"^(?:{codes})"), F.array(F.regexp_extract(ahead, rf"^(?:{of_length})(?![A-Za-z0-9])", 0))).otherwise(ends)
            match = F.get(F.filter(ends, lambda m: F.when(m != "", mod97(m)).otherwise(False)), F.lit(0))
            return _let(match, lambda m: F.struct(s["start"].alias("start"), (s["start"] + F.length(m)).alias("end"), m.alias("match")))

        # 34 characters, the spaces between them and the next one
        return _let(_cut(chunks, s["start"], F.lit(68)), look)

    def apart(found: Column) -> Column:
        # an IBAN that begins inside the last one taken goes; a chain of overlaps is walked, most have none
        ends = _scan(F.transform(found, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
        return _let(ends, lambda e: F.filter(found, lambda s, i: (i == 0) | (s["start"] >= F.coalesce(F.get(e, i - 1), F.lit(0)))))

    def taken(found: Column) -> Column:
        last = lambda acc: F.get(acc, F.size(acc) - 1)["end"]
        walk = F.aggregate(found, F.array().cast("array<struct<start:int,end:int,match:string>>"), lambda acc, s: F.when(F.coalesce(s["start"] >= last(acc), F.lit(True)), F.concat(acc, F.array(s))).otherwise(acc))
        clean = apart(found)
        return F.when(F.size(clean) == F.size(found), found).otherwise(walk)

    return _let(F.filter(F.transform(heads, whole), lambda s: s["match"].isNotNull()), taken)


def _spans(kind: Kind) -> Column:
    """Confirmed spans of a kind from its matches (column _m), the pieces between them (column _g) and the text's chunks (column _c)."""
    m, g, c = F.col("_m"), F.col("_g"), F.col("_c")
    # the end of every match: the running sum of the lengths of pieces and matches
    lengths = F.zip_with(m, F.slice(g, F.lit(1), F.size(m)), lambda x, y: F.length(x) + F.length(y))
    found = _let(_scan(lengths, lambda x, y: x + y), lambda ends: F.zip_with(m, ends, lambda x, e: F.struct((e - F.length(x)).alias("start"), e.alias("end"), x.alias("match"))))
    checked = _let(found, lambda f: _ibans(f, c)) if kind.name == "iban" else F.filter(found, lambda s: _valid(kind.name, s["match"]))
    words = rf"(?i)(?:^|[^\p{{L}}\p{{N}}])(?:{kind.context})"

    def scored(s: Column) -> Column:
        first = F.greatest(s["start"] - CONTEXT, F.lit(0))
        near = F.concat(_cut(c, first, s["start"] - first), F.lit(" "), _cut(c, s["end"], F.lit(CONTEXT)))
        score = F.lit(kind.confirmed) + F.when(near.rlike(words), F.lit(0.3)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.round(F.least(score, F.lit(1.0)), 2).alias("score"))

    spans = F.transform(checked, scored)
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= THRESHOLD)


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` never null, its chunks where it has matches (``_c``), and a column of spans for each kind (``_email``, ``_ip``, ...)."""
    out = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    keep = [c for c in out.columns if c != "_c"]
    strings = F.array().cast("array<string>")
    for kind in KINDS:
        out = out.withColumn(f"_{kind.name}_m", F.when(F.expr(kind.hint), F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))).otherwise(strings))
    # places are worked out only where there are matches
    some = F.lit(False)
    for kind in KINDS:
        some = some | (F.size(f"_{kind.name}_m") > 0)
    out = out.withColumn("_c", F.when(some, F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))).otherwise(strings))
    keep.append("_c")
    for n, kind in enumerate(KINDS):
        later = [f"_{k.name}_m" for k in KINDS[n + 1 :]]
        out = out.withColumn("_m", F.col(f"_{kind.name}_m"))
        out = out.withColumn("_g", F.when(F.size("_m") > 0, F.split("text", kind.pattern, -1)).otherwise(strings))
        keep.append(f"_{kind.name}")
        out = out.withColumn(f"_{kind.name}", F.when(F.size("_m") > 0, _spans(kind)).otherwise(F.array()).cast(_SPAN)).select(*keep, *later)
    return out


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """Per document: counts of the four base kinds, the digest of their spans, all spans and their scores."""
    found = find_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = F.concat(*[F.col(f"_{k.name}") for k in KINDS if k.base])
    every = F.concat(*[F.col(f"_{k.name}") for k in KINDS])
    counts = [F.size(f"_{k.name}").cast("long").alias(f"n_{k.name}") for k in KINDS]
    scores = F.array_join(F.transform(every, lambda s: F.format_string("%.2f", s["score"])), ",")
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"), scores.alias("scores"))


def _redacted(spans: Column, chunks: Column) -> Column:
    """A text in chunks with its spans (in order of their starts, one at least) replaced; overlapping ones become one, named after the first."""

    def rewrite(ends: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.coalesce(F.get(ends, i - 1), F.lit(0))))

        def pieces(h: Column) -> Column:
            n = F.size(h)
            end = lambda j: F.get(ends, F.coalesce(F.get(h, j + 1), F.size(spans)) - 1)

            def piece(i: Column, j: Column) -> Column:
                at = F.when(j > 0, end(j - 1)).otherwise(0)
                s = F.get(spans, i)
                return F.concat(_cut(chunks, at, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))

            last = end(n - 1)
            tail = _cut(chunks, last, F.size(chunks) * CHUNK - last)
            return F.concat(F.array_join(F.transform(h, piece), ""), tail)

        return _let(heads, pieces)

    return _let(_scan(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y)), rewrite)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``n_chars`` follows.

    Spans that overlap become one, named after the first.  Null text stays null.
    """
    found = find_spans(with_row(docs, text=F.col("text").cast("string")))
    every = F.concat(*[F.col(f"_{k.name}") for k in KINDS])
    spans = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    out = found.select("row", "_c", spans.alias("_s"))
    clean = F.when(F.size("_s") > 0, _let(F.col("_s"), lambda s: _redacted(s, F.col("_c"))))
    out = out.select("row", clean.alias("_clean"))
    changed = F.col("_clean").isNotNull()
    n_chars = F.when(changed, F.length("_clean")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else F.lit(None)
    return unpack_row(out, docs, text=F.when(changed, F.col("_clean")).otherwise(F.col("row").getField("text")), n_chars=n_chars)
