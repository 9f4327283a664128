"""Secrets in text, as spans, with weak candidates linked to their other half.

Strong patterns (assignments with long values, access identifiers, long hex
strings) are secrets by themselves. Weak ones - short values, user names,
endpoints - say nothing alone: each is reported only when a complementary part
lies within its scope, found by an interval join of the parts of a document on
stretches of its text.

Only SQL functions are used. A pattern's matches and the pieces between them give
all places, as running sums of lengths. Places count code points, ends are
exclusive. Null texts are empty. Rows are told apart by a number of their own,
so null or repeated ids are no matter. Results replace columns of the same name;
columns that have a name used on the way keep their name and their values. The work on
a text grows with its length and its number of matches, not with their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varimill.llm.frames import set_aside, stored

SCOPE = 200  # code points between parts that belong together
MASK = "[secret]"
ASSIGN_CHARS = 12
SHORT_CHARS = 6

# The patterns of the base kinds.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
# Parts that count only in company.
USER = r"""([Uu][Ss][Ee][Rr]([Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_[Ii][Dd])["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
ENDPOINT = r"""(https?|ftp|ssh|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9_.:/@?&=%-]{4,}"""

# Kind: what it is a part of, and whether it is reported by itself. In the order
# in which spans with the same start are listed.
KINDS = {
    "assign": ("secret", True),
    "access": ("user", True),
    "hex": ("secret", True),
    "short": ("secret", False),
    "user": ("user", False),
    "endpoint": ("endpoint", False),
}
BASE = ("assign", "access", "hex")
_TAKEN = ("_row", "_found", "_spans")  # columns used on the way
_NEW = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
_PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "user": USER, "endpoint": ENDPOINT}
# A part is completed by any of these.
_COMPLEMENTS = {"secret": ("user", "endpoint"), "user": ("secret",), "endpoint": ("secret",)}


def _matches(text: Column, kind: str) -> Column:
    """(characters before since the last match, characters of the match, of its value)."""
    pattern = F.lit(_PATTERNS[kind])
    group = {"assign": 2, "user": 3}.get(kind, 0)
    before = F.transform(F.split(text, _PATTERNS[kind], -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    value = F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), F.length)
    # Zipped, so that each array is made once; the piece behind the last match goes.
    zipped = F.arrays_zip(whole.alias("w"), value.alias("v"), before.alias("b"))
    found = F.transform(
        F.filter(zipped, lambda m: m["w"].isNotNull()),
        lambda m, i: F.struct(
            i.alias("i"),
            F.lit(kind).alias("pattern"),
            m["b"].alias("before"),
            m["w"].alias("size"),
            m["v"].alias("value"),
        ),
    )
    return F.when(text.rlike(_PATTERNS[kind]), found).otherwise(F.array())


def scan(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with a row number and the matches of all patterns, stored: texts
    are searched once."""
    content = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*(_matches(content, k) for k in _PATTERNS))
    rows = docs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_found", found)
    return stored(rows if keep_text else rows.drop(text), "secrets")


def parts(scanned: DataFrame) -> DataFrame:
    """``_row``, ``kind``, ``start``, ``end`` of every part, weak ones included."""
    rows = scanned.where(F.size("_found") > 0).select("_row", F.inline("_found"))
    run = Window.partitionBy("_row", "pattern").orderBy("i")
    upto = F.sum(F.col("before") + F.col("size")).over(run)
    kind = F.when(
        F.col("pattern") == "assign",
        F.when(F.col("value") >= ASSIGN_CHARS, "assign").when(F.col("value") >= SHORT_CHARS, "short"),
    ).otherwise(F.col("pattern"))
    placed = rows.withColumn("kind", kind).withColumn("end", upto)
    return placed.where("kind is not null").select(
        "_row", "kind", (F.col("end") - F.col("size")).alias("start"), "end"
    )


def _of(column: Column, values: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[column]


def spans(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``_row``, ``kind``, ``start``, ``end`` of all strong parts and of the weak
    ones with a complementary part at most ``scope`` code points away."""
    found = stored(parts(scanned), "parts").withColumns(
        {
            "role": _of(F.col("kind"), {k: r for k, (r, _) in KINDS.items()}),
            "strong": _of(F.col("kind"), {k: s for k, (_, s) in KINDS.items()}),
        }
    )

    def stretches(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))

    weak = found.where(~F.col("strong")).withColumn(
        "stretch", stretches(F.col("start") - scope, F.col("end") + scope)
    )
    other = found.select(
        F.col("_row").alias("o_row"),
        F.col("role").alias("o_role"),
        F.col("start").alias("o_start"),
        F.col("end").alias("o_end"),
        stretches(F.col("start"), F.col("end")).alias("o_stretch"),
    )
    completes = [
        (F.col("role") == role) & F.col("o_role").isin(*others) for role, others in _COMPLEMENTS.items()
    ]
    near = (F.col("o_start") <= F.col("end") + scope) & (F.col("o_end") >= F.col("start") - scope)
    linked = weak.join(
        other,
        (F.col("_row") == F.col("o_row"))
        & (F.col("stretch") == F.col("o_stretch"))
        & near
        & (completes[0] | completes[1] | completes[2]),
        "left_semi",
    )
    columns = ("_row", "kind", "start", "end")
    return found.where("strong").select(*columns).unionByName(linked.select(*columns).distinct())


def _listed(chosen: Column) -> Column:
    return F.array_join(
        F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def report(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Every row of ``docs`` without its text, with counts of the base kinds, the
    digest of their spans and the list of all spans."""
    docs, back = set_aside(docs.drop(*(c for c in _NEW if c != text)), _TAKEN)
    text = {old: new for new, old in back.items()}.get(text, text)
    scanned = scan(docs, text)
    order = _of(F.col("kind"), {k: i for i, k in enumerate(KINDS)})
    grouped = (
        spans(scanned, scope)
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(F.struct("start", order.alias("o"), "end", "kind"))).alias("_spans"))
    )
    rows = scanned.drop("_found").join(grouped, "_row", "left")
    found = F.coalesce(F.col("_spans"), F.array().cast(grouped.schema["_spans"].dataType))
    rows = rows.withColumn("_spans", found)

    def count(kind: str) -> Column:
        return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("_spans", lambda s: s["kind"].isin(*BASE))
    return rows.select(
        *(c for c in docs.columns if c != text and c not in _NEW),
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("_spans")).alias("spans"),
    ).withColumnsRenamed(back)


def redact(docs: DataFrame, text: str = "text", scope: int = SCOPE, mask: str = MASK) -> DataFrame:
    """``docs`` with every span replaced by ``mask``; overlapping spans by one.

    Only rows with a match are shuffled.
    """
    docs, back = set_aside(docs, _TAKEN)
    text = {old: new for new, old in back.items()}.get(text, text)
    scanned = scan(docs, text, keep_text=True)
    clean = scanned.where(F.size("_found") == 0).select(*docs.columns)
    grouped = _islands(spans(scanned, scope)).groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans")
    )
    rows = scanned.where(F.size("_found") > 0).join(grouped, "_row", "left")
    none = F.array().cast(grouped.schema["_spans"].dataType)
    rows = rows.withColumn("_spans", F.coalesce("_spans", none))
    walked = F.when(F.size("_spans") == 0, F.col(text)).otherwise(_masked(F.col(text), F.col("_spans"), mask))
    masked = rows.withColumn(text, walked).select(*docs.columns)
    return clean.unionByName(masked).withColumnsRenamed(back)


def _islands(found: DataFrame) -> DataFrame:
    """``_row``, ``start``, ``end`` of spans that overlap as one."""
    placed = Window.partitionBy("_row").orderBy("start", "end")
    before = F.max("end").over(placed.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col("start") >= F.coalesce(before, F.lit(-1))).cast("int")
    named = found.select("_row", "start", "end", fresh.alias("fresh"))
    named = named.withColumn("island", F.sum("fresh").over(placed.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy("_row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def _masked(content: Column, found: Column, mask: str) -> Column:
    """The text with each of its spans, in order and apart, replaced.

    The text is cut into its characters once, bound by the outer lambda, so that each
    piece between two spans costs its own length only.
    """

    def between(letters: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            low = F.when(i > 0, F.get(found, i - 1)["end"]).otherwise(0)
            kept = F.slice(letters, (low + 1).cast("int"), (s["start"] - low).cast("int"))
            return F.concat(F.array_join(kept, ""), F.lit(mask))

        low = F.element_at(found, -1)["end"]
        rest = F.slice(letters, (low + 1).cast("int"), F.greatest(F.size(letters) - low, F.lit(0)).cast("int"))
        return F.concat(F.array_join(F.transform(found, piece), ""), F.array_join(rest, ""))

    letters = F.filter(F.split(content, ""), lambda c: c != "")
    return F.element_at(F.transform(F.array(letters), between), 1)
