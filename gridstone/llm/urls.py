"""URL filters: longest host and path rules, then a listed-key test by a Bloom filter cascade.

Level 0 holds the listed keys; each further level the keys of the other kind that
pass the level before, over the complete universe of keys. The first level that
a key fails decides, so each key of the universe gets its exact answer with bit
tests alone. A level's bits lie in arrays of words, one a shard of at most SHARD_KEYS
listed keys; they reach the rows as the value of a scalar subquery, for at most
PASS_BITS bits at once. A longer list takes several passes over the rows, each over the
rows of its own shards: rows are never joined or shuffled, whatever the list's length.

The production list (`listed_keys`) is a table of keys: those of pages whose whole url or
whose title holds a listed word. All other urls of such a key are blocked with it.

Edge cases: a null url, or one without "://", has an empty host and path, no rule
and the verdict of its (empty) key; repeated rows get equal results; extra columns
are ignored; an empty table gives an empty one; an empty list blocks nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import cut

#: Verdict, host, path: fixed values.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Words of a url or title that put its key on the list.
LISTED_WORDS = """
adult adults bdsm camgirl camgirls dating escort escorts erotic erotica fetish hentai hookup lolita milf naked nude nudes
nsfw porn porno porntube sex sexcam sexshop sexy swinger threesome tits upskirt voyeur webcam xrated xxx
baccarat bet bets betting bingo blackjack bookie bookmaker casino craps gamble gambling jackpot keno lotto lottery poker roulette
slot slots sportsbook wager win
cialis kamagra levitra pharmacy phentermine pill pills steroids tramadol valium viagra xanax
botnet crack cracked crackz exploit keygen keylogger malware nulled phish phishing ransomware rootkit serialz spyware torrent torrents trojan warez
cashadvance forex getrich payday replica scam
""".split()
LISTED_PATTERN = "(^|[^a-z0-9])(" + "|".join(LISTED_WORDS) + ")([^a-z0-9]|$)"
TITLE_PATTERN = "<title[^>]*>([^<]*)"
BITS_PER_KEY, PROBES, SHARD_KEYS, PASS_BITS = 12, 4, 200_000, 1 << 29
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame, *more: Column) -> DataFrame:
    """page_id, host, path, key, and the columns `more`."""
    has = F.coalesce(F.instr("url", "://"), F.lit(0)) > 0
    rest = F.when(has, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rows = pages.select("page_id", rest.alias("rest"), *more).withColumn("raw", F.regexp_extract("rest", "^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), "^[^?#]*", 0)
    rows = rows.select(*rows.columns, F.translate("raw", UPPER, LOWER).alias("host"), path.alias("path")).drop("rest", "raw")
    return rows.withColumn("key", F.concat("host", "path"))


def ruled(rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null without one."""
    longest_first = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda host, path: ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
    cases = [F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in longest_first]
    return F.coalesce(*cases)


def positions(level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64("key", F.lit(level * 64 + k)), F.lit(bits)) for k in range(PROBES)]


def _bit(p: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))


def hit(words: Column, level: int, bits: int) -> Column:
    """All probed bits are set."""
    test = lambda p: F.get(words, F.shiftright(p, 6).cast("int")).bitwiseAND(_bit(p)) != 0
    return reduce(lambda a, b: a & b, (test(p) for p in positions(level, bits)))


def filled(keys: DataFrame, level: int, bits: int, shards: int) -> DataFrame:
    """shard, words: one array of 64-bit words a shard, with the keys' bits set.

    A zero for each word goes with the bits, so that no word is missing and the words need only be sorted."""
    size = bits // 64
    none = keys.sparkSession.range(shards * size).select(F.floor(F.col("id") / size).cast("int").alias("shard"), (F.col("id") % size).cast("int").alias("i"), F.lit(0).cast("long").alias("w"))
    p = keys.select("shard", F.explode(F.array(*positions(level, bits))).alias("p"))
    words = none.unionByName(p.select("shard", F.shiftright("p", 6).cast("int").alias("i"), _bit(F.col("p")).alias("w"))).groupBy("shard", "i").agg(F.bit_or("w").alias("w"))
    laid = words.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("w"))
    return laid.select("shard", F.transform("w", lambda x: x["w"]).alias("words"))


class Cascade:
    """Exact membership of the keys of `universe` (key, listed), by levels of Bloom filters."""

    def __init__(self, universe: DataFrame, shard_keys: int = SHARD_KEYS, pass_bits: int = PASS_BITS):
        n = universe.filter("listed").count()
        self.shards, self.pass_bits = max(1, -(-n // shard_keys)), pass_bits
        self.bits: list[int] = []
        self.tables: list[DataFrame] = []
        held = self.dealt(universe)
        for level in count():  # each level holds a small share of the keys that the one before it held
            own = F.col("listed") if level % 2 == 0 else ~F.col("listed")
            inside = held.filter(own)
            most = inside.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
            if not most:
                return
            self.bits.append(64 * max(1, -(-most * BITS_PER_KEY // 64)))
            self.tables.append(cut(filled(inside, level, self.bits[level], self.shards), "bloom"))
            # to the next level go this level's keys and the others that pass it
            held = cut(self.passes(held, lambda words, level=level: lambda rows: rows.filter(own | words(level))), "cascade")

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(self.shards)).cast("int"))

    def passes(self, rows: DataFrame, step: Callable) -> DataFrame:
        """The rows of some shards after another, each through `step(test)`, where test(level) is the test of a level."""
        some = max(1, self.pass_bits // sum(self.bits))
        out = None
        for low in range(0, self.shards, some):
            mine = F.col("shard").between(low, low + some - 1)

            def test(level: int, low: int = low, mine: Column = mine) -> Column:
                words = self.tables[level].filter(mine).agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "words"))), lambda x: x["words"]).alias("words"))
                return F.coalesce(hit(F.get(words.scalar(), F.col("shard") - low), level, self.bits[level]), F.lit(False))

            part = step(test)(rows if self.shards <= some else rows.filter(mine))
            out = part if out is None else out.unionByName(part)
        return out

    def mark(self, rows: DataFrame, name: str = "listed") -> DataFrame:
        """The rows (with key) and whether the key is listed."""
        if not self.bits:
            return rows.withColumn(name, F.lit(False))

        def step(test: Callable[[int], Column]) -> Callable[[DataFrame], DataFrame]:
            answer = F.lit(len(self.bits) % 2 == 1)
            for level in reversed(range(len(self.bits))):
                answer = F.when(~test(level), F.lit(level % 2 == 1)).otherwise(answer)
            return lambda rows: rows.withColumn(name, answer)

        return self.passes(self.dealt(rows), step).drop("shard")


def listed_keys(pages: DataFrame) -> DataFrame:
    """The production list: key of each page whose whole url or title holds a listed word."""
    words = F.lower(F.concat_ws(" ", F.coalesce("url", F.lit("")), F.regexp_extract(F.coalesce("html", F.lit("")), TITLE_PATTERN, 1)))
    return parsed(pages, words.rlike(LISTED_PATTERN).alias("found")).filter("found").select("key").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, listed: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict; `listed` is a table with a column key, by default the production list."""
    rows = parsed(pages)
    listed = listed_keys(pages) if listed is None else listed.select("key")
    # one pass over both tables gives the universe with its listed keys
    both = rows.select("key", F.lit(False).alias("listed"), F.lit(True).alias("seen")).unionByName(listed.select("key", F.lit(True).alias("listed"), F.lit(False).alias("seen")))
    universe = both.groupBy("key").agg(F.bool_or("listed").alias("listed"), F.bool_or("seen").alias("seen")).filter("seen").drop("seen")
    cascade = Cascade(cut(universe, "urls"))
    rule = ruled(rules)
    out = cascade.mark(rows.withColumn("found", rule))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


SQL = rf"""
    WITH rest AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
               lower(coalesce(url, '') || ' ' || coalesce(regexp_extract(html, '{TITLE_PATTERN}', 1), '')) AS words
        FROM pages
    ), parts AS (
        SELECT page_id, words, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
               regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
        FROM rest
    ), listed AS (
        SELECT DISTINCT host || path AS key FROM parts WHERE regexp_matches(words, '{LISTED_PATTERN}')
    ), rules (verdict, host, path) AS (
        VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}
    ), fit AS (
        SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
        FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        GROUP BY page_id
    )
    SELECT page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
    FROM parts p LEFT JOIN fit f USING (page_id) LEFT JOIN listed l ON l.key = p.host || p.path
"""
