"""URL allow and block lists as one trie over reversed host labels and path segments.

The trie is built from the rules and broadcast while their number is within a bound; hosts go down label by label from
the right, so a rule fits its host and every subdomain; below a host node the path goes down segment by segment. The
deepest fit wins: the longest host first, then the longest path. With equal rules of both kinds, block wins. Urls are
split by SQL functions, and each distinct host of a batch walks the trie once.

A longer list isn't broadcast: the same descent is a join of every suffix of a host that has rules and every folder of
its path with the rules, and the longest fit of each row is kept. A suffix and folder that very many urls have, as
`com` alone, is dealt over parts, and its rules go to each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm._spark import Stage, ship

#: Largest number of rules that is broadcast, and of their characters (a rule takes about 0.5 KB in a worker, and three times its length).
MOST_RULES, MOST_CHARACTERS = 500_000, 50_000_000
#: Urls with one suffix and folder that meet its rules in one part.
HOT = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(UPPER, LOWER)
PATH, TAILS = 0, 1  # integer keys cannot clash with labels or segments, which are strings


def host_and_path(url: str) -> tuple[Column, Column]:
    """host: after the first :// up to / ? # or the end, A-Z lowered; path: then up to ? # or the end; empty without ://."""
    some, rest = f"locate('://', `{url}`) > 0", f"substr(`{url}`, locate('://', `{url}`) + 3)"
    host = f"case when {some} then translate(regexp_extract({rest}, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') else '' end"
    path = f"case when {some} then regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) else '' end"
    return F.expr(host).alias("host"), F.expr(path).alias("path")


class UrlTrie:
    """Longest-match lookup. rules: (host, path prefix, 'allow' or 'block')."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, kind in rules:
            if kind not in ("allow", "block"):
                raise ValueError(f"a rule is allow or block, not {kind!r}")
            node = self.root
            host = host.translate(_LOWER)
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            node = node.setdefault(PATH, {})
            *segments, tail = path.split("/")
            for segment in segments:
                node = node.setdefault(segment, {})
            # what follows the last slash is a prefix of the next segment; "" fits any
            tails = node.setdefault(TAILS, {})
            if tails.get(tail, (None, "allow"))[1] == "allow":
                tails[tail] = (host + path, kind)

    def nodes(self, host: str) -> list[dict]:
        """Path nodes of the rules' hosts that fit, the longest host first."""
        found, node = [], self.root
        if PATH in node:
            found.append(node[PATH])
        for label in reversed(host.split(".")) if host else ():
            node = node.get(label)
            if node is None:
                break
            if PATH in node:
                found.append(node[PATH])
        return found[::-1]

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, kind) of the longest fit, or None."""
        return next((best for node in self.nodes(host) if (best := self._path(node, path))), None)

    @staticmethod
    def _path(node: dict | None, path: str) -> tuple[str, str] | None:
        best = None
        segments = path.split("/")
        for i, segment in enumerate(segments):
            if node is None:
                break
            tails = node.get(TAILS)
            if tails:
                fits = [t for t in tails if segment.startswith(t)] if len(tails) < 16 else [segment[:k] for k in range(len(segment) + 1) if segment[:k] in tails]
                if fits:
                    best = tails[max(fits, key=len)]
            node = node.get(segment) if i + 1 < len(segments) else None
        return best


def _by_trie(urls: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    spark = urls.sparkSession
    ship(spark)
    trie = spark.sparkContext.broadcast(UrlTrie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie.value
        for rb in batches:
            coded = rb.column(1).dictionary_encode()
            nodes = [t.nodes(host) for host in coded.dictionary.to_pylist()]
            paths = rb.column(2)
            hits = []
            for k, at in enumerate(coded.indices.to_pylist()):
                fit = None
                for node in nodes[at]:
                    fit = t._path(node, paths[k].as_py())
                    if fit:
                        break
                hits.append(fit)
            names, verdicts = [h and h[0] for h in hits], [h[1] if h else default for h in hits]
            yield pa.record_batch([rb.column(0), rb.column(1), paths, pa.array(names, pa.string()), pa.array(verdicts, pa.string())], ["id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(judge, f"id {urls.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string")


def _by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by a join: a rule has one folder (its path up to the last slash), a url one for each slash of its path, and the whole start."""
    folder = F.regexp_extract("rule_path", "^(?:.*/)?", 0)
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("kind").alias("kind"))
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("kind").alias("kind")).withColumn("folder", folder.alias("folder"))  # of both, block
    stage = Stage(urls.sparkSession, "urls")
    urls = stage.save(urls.withColumn("row", F.monotonically_increasing_id()), "rows")
    labels = "split(host, '[.]')"
    hosts = f"array_distinct(array_append(transform(sequence(1, size({labels})), i -> concat_ws('.', slice({labels}, i, size({labels})))), ''))"
    parts = "split(path, '/')"
    folders = f"transform(sequence(0, size({parts}) - 1), i -> array_join(transform(slice({parts}, 1, i), p -> concat(p, '/')), ''))"
    # suffixes without rules go before their folders are made; those with rules are at most as many as the rules
    known = rules.select("rule_host").distinct()
    asked = urls.select("row", "path", F.explode(F.expr(hosts)).alias("rule_host"), F.expr(folders).alias("folders")).join(known, "rule_host", "left_semi")
    asked = asked.select("row", "path", "rule_host", F.explode("folders").alias("folder"))
    key = ["rule_host", "folder"]
    asked = stage.save(asked.join(rules.select(*key).distinct(), key, "left_semi"), "asked")
    hot = stage.save(asked.groupBy(*key).agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")).where("parts > 1"), "hot")
    dealt = lambda df: df.join(hot, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    asked = dealt(asked).withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int")).drop("parts")
    rules = dealt(rules).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    fits = asked.join(rules, [*key, "part"]).where("startswith(path, rule_path)")
    best = fits.groupBy("row").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "kind"), F.struct(F.length("rule_host"), F.length("rule_path"))).alias("hit"))
    out = urls.join(best, "row", "left")
    return out.select("id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.kind", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for each row: the longest fitting rule, else null and `default`.

    rules: (host, path prefix, 'allow' or 'block'), as tuples or as a DataFrame with columns host, path, kind. A null
    url, or one without ://, has an empty host and path and gets the default verdict unless a rule of an
    empty host and path fits. Repeated rows and null ids are returned as they are; other columns aren't read; no rows give no rows.
    """
    urls = pages.select(F.col(id_col).alias("id"), *host_and_path(url_col))
    urls = urls.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    if not isinstance(rules, DataFrame):
        rest = iter(rules)
        first = list(itertools.islice(rest, MOST_RULES + 1))
        if len(first) <= MOST_RULES and sum(len(h) + len(p) for h, p, _ in first) <= MOST_CHARACTERS:
            return _by_trie(urls, first, default).withColumnRenamed("id", id_col)
        rules = pages.sparkSession.createDataFrame([*first, *rest], "host string, path string, kind string")
    rules = rules.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("host", "path", "kind")])
    if bad := rules.where("kind not in ('allow', 'block')").limit(1).collect():
        raise ValueError(f"a rule is allow or block, not {bad[0].kind!r}")
    n, characters = rules.agg(F.count("*"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0))).first()
    few = n <= MOST_RULES and characters <= MOST_CHARACTERS
    out = _by_trie(urls, [tuple(r) for r in rules.collect()], default) if few else _by_join(urls, rules, default)
    return out.withColumnRenamed("id", id_col)
