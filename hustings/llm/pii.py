"""Personal data: patterns propose, checksums confirm, context adjusts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import narrow, read

#: Kinds of span in the order in which ties at one start are listed.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]

#: A run of the class can only match from where it begins: at no other place could
#: it match if it doesn't there.  \G also allows what an earlier match left of it.
#: With possessive repeats this takes linear time and no stack, however long the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: What a text must hold for a pattern to be tried at all: a plain search is quicker.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Words near a span that speak for its kind (fixed values).
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
}
#: Score of a span by kind before context: a checksum is worth more than a shape.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.95}
BONUS, NEAR = 0.1, 40

#: At most 255, whatever zeros stand before.
_OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|(?<=0))"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number passes the mod-97 check (first four moved last)."""
    compact = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))

    def step(rest: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        value = F.when(code >= 65, code - 55).otherwise(code - 48)
        return F.when(value > 9, (rest * 100 + value) % 97).otherwise((rest * 10 + value) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda x: x != ""), F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits(match)).between(14, 19) & luhn(digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def _check(kind: str):
    return lambda span: _confirmed(kind, span["match"])


def _is(kind: str):
    return lambda span: span["kind"] == kind


def _proposed(kind: str) -> Column:
    """(start, end, match) of each leftmost, non-overlapping match: code points.

    Spark has no function for a match's place, but the gaps between matches
    (split) and the matches are the whole text, so lengths give the places.
    """
    matches = F.col(f"{kind}_matches")
    walk = F.aggregate(
        F.sequence(F.lit(1), F.size(matches)),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int,match:string>>)").alias("out")),
        lambda acc, i: _next(acc, F.element_at(F.col(f"{kind}_gaps"), i), F.element_at(matches, i)),
    )
    return walk["out"]


def _next(acc: Column, gap: Column, match: Column) -> Column:
    start = acc["at"] + gap
    stop = start + F.char_length(match)
    return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), match.alias("match")))).alias("out"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in each text.

    ``spans`` is an array of (start, kind_no, kind, stop, score), ordered by start and
    then kind; places count code points, stop exclusive.  A match that its check
    refuses is dropped and not tried again.  The score is the kind's own, plus a
    bonus if a context word of the kind stands within 40 code points before.

    Null and empty texts have no spans; each row gives one row, repeated or not; an empty
    table gives no rows.  Patterns take linear time and no stack, however long a text is.
    """
    rows = narrow(docs, id_col, text_col)
    # Matches, gaps and spans are columns one by one: none is worked out twice.
    rows = rows.withColumns({
        f"{k}_matches": F.when(F.contains("text", F.lit(NEEDS[k])) if k in NEEDS else F.lit(True), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(F.array().cast("array<string>"))
        for k in KINDS
    })
    rows = rows.withColumns({
        f"{k}_gaps": F.when(F.size(f"{k}_matches") > 0, F.transform(F.split("text", PATTERNS[k], -1), lambda g: F.char_length(g))) for k in KINDS
    })
    rows = rows.withColumns({
        f"{k}_spans": F.when(F.size(f"{k}_matches") > 0, F.filter(_proposed(k), _check(k))) for k in KINDS
    })

    def scored(kind: str) -> Column:
        def one(s: Column) -> Column:
            before = F.lower(F.substring(F.col("text"), F.greatest(s["start"] - NEAR, F.lit(0)) + 1, F.least(s["start"], F.lit(NEAR))))
            near = before.rlike("(?<![a-z])(?:" + "|".join(CONTEXT[kind]) + ")(?![a-z])")
            score = F.least(F.lit(1.0), F.lit(BASE_SCORE[kind]) + F.when(near, F.lit(BONUS)).otherwise(F.lit(0.0)))
            return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), F.lit(kind).alias("kind"), s["stop"].alias("stop"), score.alias("score"))

        empty = F.expr("cast(array() as array<struct<start:int,kind_no:int,kind:string,stop:int,score:double>>)")
        return F.coalesce(F.transform(f"{kind}_spans", one), empty)

    return rows.select("doc_id", F.array_sort(F.concat(*(scored(k) for k in KINDS))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest, and all spans as text."""
    show = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE_KINDS))
    return found.select(
        "doc_id",
        *(F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(F.array_join(F.transform(base, show), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", show), ",").alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )


def query(spark, sf_dir):
    return digest(find(read(spark, sf_dir, "documents")))
