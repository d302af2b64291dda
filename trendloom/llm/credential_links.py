"""Secrets in texts, and weaker parts of credentials that belong together.

Three kinds of spans are found by their form alone (``BASE``).  Weaker candidates are
reported only with their complements: a login name or key id (identifier) near a
secret, a random-looking value (secret) near an identifier, an address (endpoint) near
both.  Near means inside one scope, a block of text up to a blank line, with starts at
most ``reach`` code points apart.  Candidates that overlap a base span are part of it.

DataFrame functions only:

1. one pass cuts every text at the matches of each pattern; lengths of the pieces and
   of the matches are written, not texts;
2. running sums per row and kind make positions of them, running counts per row number
   the scopes and drop what overlaps a base span;
3. interval join: positions fall into cells as wide as the reach.  Each cell is first
   reduced to the first and last start of each role, then a candidate meets its own cell
   and the two beside it by equality, and the reach decides.  A cell with many parts is
   one row per role, so no pairs come up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.session import materialize

REACH = 300


def either_case(word: str) -> str:
    """A pattern for the word with its letters in either case, ASCII only."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _named(names: list[str], value: str) -> str:
    """A pattern for one of the names, a colon or equals sign, and a value, maybe quoted."""
    return f"(?:{'|'.join(map(either_case, names))})" + r"""["']?\x20*[:=]\x20*["']?(""" + value + ")"


#: Kinds in the order in which they are listed: pattern, group that is measured, least length of it.
BASE = {
    "assign": (_named(["password", "passwd", "secret", "token", "api_?key"], "[A-Za-z0-9+/_.=-]+"), 1, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
}
WEAK = {
    "identifier": (_named(["user_?name", "user", "login", "account", "client_?id", "access_?key_?id"], "[A-Za-z0-9@+/_.=-]+"), 1, 3),
    "secret": ("[A-Za-z0-9+/_-]+", 0, 16),
    "endpoint": (
        r"(?:https?|s?ftp|ssh|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20\x22\x27<>]+"
        r"|[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}(?::[0-9]+)?",
        0,
        7,
    ),
}
KINDS = [*BASE, *WEAK]
#: A random-looking value has all of these.
RANDOM = ["[a-z]", "[A-Z]", "[0-9]"]
BREAK = r"\n[\x20\x09\x0D]*\n"
#: What a kind stands for where parts are linked, and the roles that each weak kind needs.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}
NEEDS = {"identifier": ["secret"], "secret": ["identifier"], "endpoint": ["identifier", "secret"]}


def searched(kind: str) -> tuple[str, int]:
    """The pattern to search for, and the length below which a match's group fails.

    A run of one class of characters is as good as the longest run, so its least length
    can be part of the pattern and short runs make no matches.
    """
    pattern, _, least = {**BASE, **WEAK}[kind]
    if pattern.endswith("]+") and pattern.count("[") == 1:
        fixed = len(pattern.split("[")[0])
        return f"{pattern[:-1]}{{{least - fixed},}}", 0
    return pattern, least


def _pieces(text: Column, kind: str) -> Column:
    """Matches of the kind in their order: code points before (since the last one), in it, and whether it counts."""
    pattern, least = (BREAK, 0) if kind == "break" else searched(kind)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    fields = {"gap": F.split(text, pattern, -1), "match": matches}
    if least and {**BASE, **WEAK}[kind][1]:
        fields["value"] = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    zipped = F.arrays_zip(*[c.alias(name) for name, c in fields.items()])

    def piece(x: Column) -> Column:
        good = F.length(x["value" if "value" in fields else "match"]) >= least
        if kind == "secret":
            for form in RANDOM:
                good &= x["match"].rlike(form)
        return F.struct(
            F.lit(kind).alias("kind"), F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("size"), good.alias("good")
        )

    # The last piece has no match after it.
    found = F.filter(F.transform(zipped, piece), lambda x: x["size"].isNotNull())
    return F.when(text.rlike(pattern), found)


def _matches(docs: DataFrame) -> DataFrame:
    """row, doc_id and the pieces of each kind that the text has."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.array_compact(F.array(*[_pieces(text, kind) for kind in [*KINDS, "break"]])).alias("found"),
    )


def _spans(matches: DataFrame) -> DataFrame:
    """row, kind, start, end, scope of the spans that count, weak ones that overlap a base span left out."""
    # Blank lines alone, which come last, are no parts.
    parted = matches.filter((F.size("found") > 0) & (F.get(F.get("found", F.lit(0)), F.lit(0))["kind"] != "break"))
    pieces = parted.select("row", F.explode("found").alias("k")).select("row", F.posexplode("k").alias("place", "p"))
    pieces = pieces.select("row", "place", "p.*")
    upto = Window.partitionBy("row", "kind").orderBy("place")
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    spans = pieces.select("row", "kind", "size", "good", end.alias("end")).filter("good")
    spans = spans.withColumn("start", F.col("end") - F.col("size"))
    base = F.col("kind").isin(list(BASE))
    # A base span counts from its start on, a weak one asks at its end: those that began
    # before it, and reach beyond its start, overlap it.
    when = F.when(base, F.col("start")).otherwise(F.col("end"))
    before = Window.partitionBy("row").orderBy("at", base.cast("int")).rowsBetween(Window.unboundedPreceding, -1)
    covered = F.max(F.when(base, F.col("end"))).over(before)
    by_start = Window.partitionBy("row").orderBy("start", (F.col("kind") != "break").cast("int"))
    scope = F.count(F.when(F.col("kind") == "break", True)).over(by_start)
    spans = spans.withColumn("at", when).withColumn("covered", covered).withColumn("scope", scope)
    kept = base | F.col("covered").isNull() | (F.col("covered") <= F.col("start"))
    return spans.filter((F.col("kind") != "break") & kept).select("row", "kind", "start", "end", "scope")


def _linked(spans: DataFrame, reach: int) -> DataFrame:
    """The weak spans whose complements are near."""
    role = F.create_map(*[F.lit(x) for item in ROLES.items() for x in item])
    parts = spans.select("*", role[F.col("kind")].alias("role"), F.floor(F.col("start") / reach).alias("cell"))
    cells = parts.groupBy("row", "scope", "cell", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    beside = F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))
    weak = parts.filter(F.col("kind").isin(list(WEAK))).withColumn("cell", beside)
    near = (F.col("last") >= F.col("start") - reach) & (F.col("first") <= F.col("start") + reach)
    met = weak.drop("role").join(cells, ["row", "scope", "cell"]).filter(near)
    roles = met.groupBy("row", "kind", "start", "end").agg(F.collect_set("role").alias("roles"))
    needed = [(F.col("kind") == kind) & F.forall(F.array(*map(F.lit, needs)), lambda x: F.array_contains("roles", x)) for kind, needs in NEEDS.items()]
    return roles.filter(needed[0] | needed[1] | needed[2]).select("row", "kind", "start", "end")


def credentials(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array of (start, place, kind, end).

    Positions are code points of the whole text, ends exclusive; ``place`` is the kind's
    place in ``KINDS``, and spans come by start, then place.  A null text counts as empty
    and has no spans.  Rows that repeat an id stand for themselves.
    """
    matches = materialize(_matches(docs), "credential-matches")
    spans = materialize(_spans(matches), "credential-spans")
    base = spans.filter(F.col("kind").isin(list(BASE))).select("row", "kind", "start", "end")
    kinds = F.array(*[F.lit(kind) for kind in KINDS])
    span = F.struct("start", (F.array_position(kinds, F.col("kind")) - 1).cast("int").alias("place"), "kind", "end")
    listed = base.unionByName(_linked(spans, reach)).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.expr("array()").cast(listed.schema["spans"].dataType)
    return matches.select("row", "doc_id").join(listed, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def listing(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, the digest of the base spans, and all spans."""
    base = F.filter("spans", lambda s: s["place"] < len(BASE))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"))
