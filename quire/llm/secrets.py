"""Secret scans with multipart credential linking. DataFrame functions only.

Sure findings are assignments of long values, access identifiers and long hex runs. Weak candidates - short assigned values,
truncated access identifiers, user names and service endpoints - are reported only if complementary parts co-occur within their
scope: a weak secret beside an identifier or an endpoint, a weak identifier beside a secret, an endpoint beside both. Two parts
are beside each other if at most SCOPE code points lie between the end of one and the start of the other, or they overlap,
however long they are.

Places of matches come from splitting the text at the pattern and adding up lengths. Documents without any part, which are most,
cost one look per pattern. The interval join is one of a row's own parts, in its array: weak parts are held against the few
parts that may complete them. Nothing is shuffled. The cost grows with the square of the parts of one text, not of the table.

Defined results: a null text counts as empty; no findings, empty spans. Repeated rows each get theirs. Texts of any length are
scanned whole. An empty table yields no rows. Places are code points, ends exclusive; of equal places the order is that of KINDS.
Columns of the table may have any name but that of the text column, which is `text`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = 300

_VALUE = r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: kind, pattern, least characters of the group, group. The first three are sure; of the others 'where' tells what they need.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))" + _VALUE
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ACCESS_WEAK = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{8,13}(?![A-Za-z0-9])"
USER = r"(?i:(client_?id|access_?key_?id|account_?id|username|user_?id|login))" + _VALUE
ENDPOINT = r"(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s\"'<>]+"
KINDS = ["assign", "access", "hex", "weak_secret", "weak_access", "user", "endpoint"]


def _matches(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0, weak: str | None = None) -> Column:
    """array<struct<start, order, kind, end, value_end>> of the pattern's matches, leftmost first, without overlap.

    The text's pieces between matches and the matches alternate, so starts are sums of lengths before. With `least`, matches whose
    group is shorter are dropped, or kept as kind `weak` if they have half of it.
    """
    pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(pieces.alias("piece"), whole.alias("found"), value.alias("value"))
    # The sum of lengths runs along the few matches of a text.
    empty = F.lit(0).cast("int")
    lengths = F.transform(zipped, lambda z: F.struct(F.length(z["piece"]).alias("before"), F.coalesce(F.length(z["found"]), empty).alias("n"), F.coalesce(F.length(z["value"]), empty).alias("v")))
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,v:int>>)").alias("out"))
    walked = F.aggregate(
        lengths,
        state,
        lambda a, x: F.struct((a["at"] + x["before"] + x["n"]).alias("at"), F.when(x["n"] > 0, F.concat(a["out"], F.array(F.struct((a["at"] + x["before"]).alias("start"), (a["at"] + x["before"] + x["n"]).alias("end"), x["v"].alias("v"))))).otherwise(a["out"]).alias("out")),
        lambda a: a["out"],
    )
    name = lambda m: F.when(m["v"] >= least, F.lit(kind)).otherwise(F.lit(weak or kind)) if least else F.lit(kind)
    kept = F.filter(walked, lambda m: m["v"] >= (least if not weak else (least + 1) // 2)) if least else walked
    named = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), name(m).alias("kind")))
    return F.when(text.rlike(pattern), named).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,kind:string>>)"))


def scan(docs: DataFrame, keep: list[str], scope: int = SCOPE) -> DataFrame:
    """The columns `keep` in the struct `row`, and `spans`: array<struct<start, end, kind>> in order, of every row."""
    text = F.col("text")
    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = F.concat(
        _matches(text, ASSIGN, "assign", 2, 12, "weak_secret"),
        _matches(text, ACCESS, "access"),
        _matches(text, HEX, "hex"),
        _matches(text, ACCESS_WEAK, "weak_access"),
        _matches(text, USER, "user"),
        _matches(text, ENDPOINT, "endpoint"),
    )
    order = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
    placed = frame.select("row", F.array_sort(F.transform(parts, lambda p: F.struct(p["start"].alias("start"), order(p["kind"]).alias("order"), p["end"].alias("end"), p["kind"].alias("kind")))).alias("parts"))
    of = lambda *kinds: F.filter("parts", lambda p: p["kind"].isin(*kinds))
    # One column for all groups: it is named often, so that the optimizer does not work it out anew for each part.
    grouped = placed.select("row", F.struct("parts", of("assign", "weak_secret").alias("secret"), of("access", "weak_access", "user").alias("identifier"), of("endpoint").alias("endpoint")).alias("g"))
    beside = lambda group, p: F.exists(F.col(f"g.{group}"), lambda q: (q["start"] - p["end"] <= scope) & (p["start"] - q["end"] <= scope))
    reported = lambda p: (
        F.when(p["kind"] == "weak_secret", beside("identifier", p) | beside("endpoint", p))
        .when(p["kind"].isin("weak_access", "user"), beside("secret", p))
        .when(p["kind"] == "endpoint", beside("secret", p) & beside("identifier", p))
        .otherwise(True)
    )
    return grouped.select("row", F.filter("g.parts", reported).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the sure kinds, the hash of their spans, and all spans."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    sure = F.filter("spans", lambda s: s["order"] <= 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs, ["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(written(sure).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every reported span of the text replaced by <kind>; overlapping spans by one mark; n_chars follows the text."""
    names = docs.columns
    found = scan(docs, names)
    # Overlapping spans are joined, then the text is put together from what lies between them.
    span = "array<struct<start:int,end:int,kind:string>>"
    last = lambda a: F.element_at(a, -1)
    joined = lambda a, s: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"), last(a)["kind"].alias("kind"))))
    added = lambda a, s: F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    merged = F.aggregate("spans", F.expr(f"cast(array() as {span})"), lambda a, s: F.when((F.size(a) > 0) & (s["start"] < last(a)["end"]), joined(a, s)).otherwise(added(a, s)))
    frame = found.select("row", merged.alias("m"))
    m, text = F.col("m"), F.col("row.text").cast("string")
    begins = F.transform(m, lambda x, i: F.struct(F.when(i == 0, 0).otherwise(F.try_element_at(m, i)["end"]).alias("from"), x["start"].alias("to"), x["kind"].alias("kind")))
    cut = F.concat(
        F.array_join(F.transform(begins, lambda b: F.concat(F.substr(text, b["from"] + 1, b["to"] - b["from"]), F.lit("<"), b["kind"], F.lit(">"))), ""),
        F.substr(text, F.try_element_at(m, F.lit(-1))["end"] + 1),
    )
    new = F.when(F.size(m) > 0, cut).otherwise(text)
    made = frame.select("row", new.alias("new"))
    column = lambda c: F.col("new") if c == "text" else F.length("new").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"row.`{c}`")
    return made.select(*[column(c).alias(c) for c in names])
