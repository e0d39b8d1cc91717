"""Secret scans: spans that look like credentials, and whose they are across the corpus.

Every candidate's hash is counted by the distinct owners and repositories that hold it. What many owners hold, or what
stands in many repositories of fewer, is a copied example; the rest is taken for a live credential. Only DataFrame
functions are used, and the work on a text grows with its length alone, however many candidates it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import let, others, quoted, stored

# The kinds in order with their patterns, and the least length of what must be long enough.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
# A run of capitals and digits, or of hex digits, is matched whole: asking for the length loses no match.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Further candidates: long runs that mix cases and digits. They become spans if they are live and touch no base span.
MIXED = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "mixed"]

#: A value that this many owners hold, or that stands in this many repositories, is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 8
#: Entries of an array that are summed up together.
BLOCK = 256
MASK = "[SECRET]"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _top(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(-1).cast("bigint"))


def _before(values: Column, fold, both) -> Column:
    """For each entry the ``fold`` of those before it: by blocks, so that it stays nearly linear in their number.

    ``values`` must be a column or a variable, as lambdas name it. ``fold`` of no entries is what changes nothing; ``both``
    puts two folds together.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: fold(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
    starts = lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda b: fold(F.slice(x, F.lit(1), b)))

    def within(start: Column) -> Column:
        b = lambda k: F.floor(k / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda k: both(start[b(k)], fold(F.slice(values, b(k) * BLOCK + 1, k - b(k) * BLOCK))))

    return let(blocks, lambda x: let(starts(x), within))


def _sums_before(values: Column) -> Column:
    return _before(values, _sum, lambda a, b: a + b)


def _tops_before(values: Column) -> Column:
    """For each entry the largest of those before it, -1 for the first; entries aren't negative."""
    return _before(values, _top, lambda a, b: F.greatest(a, b))


def _spans(text: Column, kind: int, pattern: str, group: int = 0, counts=lambda v: F.lit(True)) -> Column:
    """The matches of a pattern whose ``group`` counts as structs of start, kind, end (code points) and that group's hash."""
    regex = F.lit(pattern)
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,hash:string>>")

    def located(matches: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        steps = let(pieces, lambda p: F.transform(matches, lambda m, k: (F.length(p[k]) + F.length(m)).cast("bigint")))
        own = F.transform(matches, lambda m: F.length(m).cast("bigint"))
        value = matches if not group else F.regexp_extract_all(text, regex, F.lit(group))

        def built(step: Column) -> Column:
            # A match ends where the pieces and matches up to it end.
            ends = lambda before: F.transform(F.arrays_zip(before.alias("b"), step.alias("s"), own.alias("n"), value.alias("v")), lambda x: F.struct(
                (x["b"] + x["s"] - x["n"]).alias("start"), F.lit(kind).alias("kind"), (x["b"] + x["s"]).alias("end"), x["v"].alias("v")))
            kept = F.filter(let(_sums_before(step), ends), lambda x: counts(x["v"]))
            return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.md5(x["v"].cast("binary")).alias("hash")))

        return let(steps, built)

    return let(F.regexp_extract_all(text, regex, F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(located(m)))


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with these columns through a generator of one row: what uses them, in a lambda too, doesn't work them out again."""
    return df.select("*", F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def found(df: DataFrame, body: str) -> DataFrame:
    """``df`` with ``base``, the base spans of the texts ``body`` by start and kind, and ``mixed``, the further candidates that touch none.

    All are sorted together. A span touches one before it if the largest base end so far lies beyond its start, and one
    after it if the smallest base start from there on lies before its end.
    """
    text, far, zero = F.col(body), F.lit(1 << 62).cast("bigint"), F.lit(0).cast("bigint")
    base = F.sort_array(F.concat(_spans(text, 0, ASSIGN, 2, lambda v: F.length(v) >= ASSIGN_VALUE), _spans(text, 1, ACCESS), _spans(text, 2, HEX)))
    mixed = _spans(text, 3, MIXED, counts=lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]"))
    df = _with(df, base=base, every_mixed=mixed)
    tagged = lambda spans, own: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), x["hash"].alias("hash"), x["kind"].alias("kind")))
    both = F.array_sort(F.concat(tagged(F.col("base"), False), tagged(F.col("every_mixed"), True)))
    df = _with(df, every=F.when((F.size("base") > 0) & (F.size("every_mixed") > 0), both))
    ends = F.transform("every", lambda x: F.when(x["own"], zero).otherwise(x["end"]))
    # The smallest of what comes after is the largest before, seen from the other end.
    starts = F.reverse(F.transform("every", lambda x: F.when(x["own"], zero).otherwise(far - x["start"])))
    df = _with(df, ends=ends, starts=starts)
    there = lambda c: F.when(F.col("every").isNotNull(), c)
    df = _with(df, zipped=there(F.arrays_zip(F.col("every").alias("x"), _tops_before(F.col("ends")).alias("e"), F.reverse(_tops_before(F.col("starts"))).alias("s"))))
    free = F.filter("zipped", lambda z: z["x"]["own"] & (z["e"] <= z["x"]["start"]) & ((z["s"] <= 0) | (far - z["s"] >= z["x"]["end"])))
    apart = F.transform(free, lambda z: F.struct(z["x"]["start"].alias("start"), z["x"]["kind"].alias("kind"), z["x"]["end"].alias("end"), z["x"]["hash"].alias("hash")))
    return _with(df, mixed=F.coalesce(apart, "every_mixed")).drop("every_mixed", "every", "ends", "starts", "zipped")


def ownership(candidates: DataFrame) -> DataFrame:
    """``candidates`` (hash, owner, repository) counted: hash, n_owners, n_repositories, live. A null is an owner of its own."""
    pairs = candidates.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    by_hash = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"))
    return by_hash.withColumn("live", (F.col("n_owners") < EXAMPLE_OWNERS) & (F.col("n_repositories") < EXAMPLE_REPOSITORIES))


def scan(docs: DataFrame, owner: Column, repository: Column, text: str = "text", keep_text: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` with ``spans`` and ``base``: arrays of start, kind (place in ``KINDS``), end, hash, live.

    ``base`` has the spans of the three base kinds, live or not; ``spans`` also the live ones of the fourth. Null texts
    have none. Spans of a kind don't overlap; ends are exclusive; places count code points. ``owner`` and ``repository``
    tell whose a row is. Repeated rows are scanned each. Own columns ``spans`` and ``base`` are replaced, others may have
    any name.

    Rows are stored once with their candidates. Which of a list of candidates are live is worked out once for all rows that
    hold the same list, and joined back to the rows that have any.
    """
    kept = [c for c in others(docs, ["spans", "base"]) if keep_text or c != text]
    # The table's own columns stand in one struct, so that none can clash with a name used here.
    marked = found(docs.select(F.struct(*quoted(kept)).alias("row"), owner.alias("owner"), repository.alias("repository"), F.coalesce(F.col(text), F.lit("")).alias("body")), "body").drop("body")
    hashes = F.transform(F.concat("base", "mixed"), lambda x: x["hash"])
    marked = stored(marked.withColumn("list", F.when(F.size(hashes) > 0, F.md5(F.array_join(hashes, ",").cast("binary")))), "candidates")
    some = marked.where("list is not null")
    counted = stored(ownership(some.select("owner", "repository", F.explode(F.array_distinct(hashes)).alias("hash"))), "ownership")
    # As many rows for a list as it has candidates: its text's own.
    entries = some.select("list", hashes.alias("hashes")).groupBy("list").agg(F.first("hashes").alias("hashes")).select("list", F.posexplode("hashes").alias("at", "hash"))
    judged = entries.join(counted.where("live").select("hash", "live"), "hash", "left").select("list", F.struct("at", F.coalesce("live", F.lit(False)).alias("live")).alias("flag"))
    flags = stored(judged.groupBy("list").agg(F.sort_array(F.collect_list("flag")).alias("flags")), "live-lists")
    told = some.join(flags, "list", "left").unionByName(marked.where("list is null").withColumn("flags", F.lit(None).cast("array<struct<at:int,live:boolean>>")))
    live = lambda spans, first: F.transform(spans, lambda x, k: F.struct(x["start"], x["kind"], x["end"], x["hash"], F.col("flags")[k + first]["live"].alias("live")))
    base, mixed = live(F.col("base"), F.lit(0)), F.filter(live(F.col("mixed"), F.size("base")), lambda x: x["live"])
    # Only then the own columns come out: a name in a lambda could be taken for one of theirs.
    told = told.select("row", F.sort_array(F.concat(base, mixed)).alias("spans"), base.alias("base"))
    return told.select("row.*", "spans", "base")


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with its live spans masked; those that overlap are masked as one. Null stays null."""
    # Four bytes for each code point: so a part is cut out at once, however far on it stands.
    wide = F.encode(text, "UTF-32")

    def covered(raw: Column, live: Column, tops: Column) -> Column:
        part = lambda a, b: F.decode(F.substring(raw, (4 * a + 1).cast("int"), (4 * (b - a)).cast("int")), "UTF-32")
        ahead = F.transform(F.arrays_zip(live.alias("x"), tops.alias("top")), lambda z: F.when(
            z["x"]["start"] >= F.greatest(z["top"], F.lit(0)), F.concat(part(F.greatest(z["top"], F.lit(0)), z["x"]["start"]), F.lit(MASK))).otherwise(""))
        end = F.array_max(F.transform(live, lambda x: x["end"]))
        return F.concat(F.array_join(ahead, ""), part(end, F.length(text).cast("bigint")))

    def mask(live: Column) -> Column:
        ends = F.transform(live, lambda x: x["end"])
        return let(wide, lambda raw: let(let(ends, _tops_before), lambda tops: covered(raw, live, tops)))

    return let(F.filter(spans, lambda x: x["live"]), lambda live: F.when(F.size(live) == 0, text).otherwise(mask(live)))
