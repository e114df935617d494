"""Text functions as column expressions. Lengths and positions count code points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The stop words that the lexical index leaves out.
STOP_WORDS = ["的", "了", "是", "在", "有", "和", "与", "或", "但", "而"]

# Words that make a question a medical one for the choice of a rerank prompt.
MEDICAL_WORDS = ["医学", "诊断", "治疗", "病", "症状", "检查", "超声", "影像"]

# How an image hit's caption and path are written into its content.
CAPTION_MARK, PATH_MARK = "图片描述: ", "图片路径: "

# Fixed value: what a figure caption in a text looks like.
CAPTION_PATTERN = r"(图\d+-\d+\s+[\p{L}\p{N}_\s（）(),]+)"


def raw_tokens(text: Column, leave_out: list[str] | None = None) -> Column:
    """Lowered runs of letters, digits and underscores; a run of Han characters gives its bigrams (itself if single). leave_out: Han words that go."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\p{IsHan}+|[\p{L}\p{N}_&&[^\p{IsHan}]]+"), 0)
    plain = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)

    def split(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
        return F.when(t.rlike(r"^\p{IsHan}{2}"), pairs).otherwise(F.array(t))

    # no Han character is below U+2E80, and that is cheap to see
    some = F.flatten(F.transform(runs, split))
    return F.when(text.rlike("[\u2e80-\U0010ffff]"), F.filter(some, lambda t: ~t.isin(leave_out)) if leave_out else some).otherwise(plain)


def tokens(text: Column) -> Column:
    """raw_tokens without the stop words; null for a null text."""
    return raw_tokens(text, STOP_WORDS)


def overlap(query: Column, content: Column) -> Column:
    """Share of the query's distinct tokens that the content has; 0 for an empty query."""
    q = F.array_distinct(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, content)) / F.size(q)).otherwise(0.0)


def length_score(content: Column, ideal: int = 200) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(F.length(content) - ideal) / ideal)


def position_bonus(position: Column, n: Column) -> Column:
    """From 1 for the first of n (position 0) down towards 0.8."""
    return F.when(n <= 1, 1.0).otherwise(1 - position / n * 0.2)


def clean(text: Column) -> Column:
    """Line ends and runs of white space as one space, the ellipsis character as three dots, trimmed."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("…"), F.lit("...")), r"\s+", " "))


def truncate_sentences(text: Column, limit: int) -> Column:
    """The text if it fits, else the most whole sentences (ending in 。) that fit, else limit - 3 characters and dots."""
    parts = F.filter(F.split(text, "。"), lambda s: s != "")
    step = lambda a, s: F.when(a["full"] | (F.length(a["out"]) + F.length(s) + 1 > limit), F.struct(a["out"].alias("out"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(a["out"], s, F.lit("。")).alias("out"), F.lit(False).alias("full")))
    kept = F.aggregate(parts, F.struct(F.lit("").alias("out"), F.lit(False).alias("full")), step, lambda a: a["out"])
    return F.when(F.length(text) <= limit, text).when(kept != "", kept).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def parse_order(reply: Column, n: Column) -> Column:
    """0-based ranking from a model's reply: its digits and commas, split, in range, first mention only, the rest appended.

    Empty when nothing valid is left; the caller then keeps its own order.
    """
    numbers = F.transform(F.split(F.regexp_replace(reply, "[^0-9,]", ""), ","), lambda s: s.try_cast("bigint") - 1)
    ranked = F.array_distinct(F.filter(numbers, lambda i: i.isNotNull() & (i >= 0) & (i < n)))
    rest = F.array_except(F.sequence(F.lit(0).cast("bigint"), F.greatest(n, F.lit(1)).cast("bigint") - 1), ranked)
    return F.when(F.size(ranked) > 0, F.concat(ranked, rest)).otherwise(F.array().cast("array<bigint>"))


def captions(content: Column) -> Column:
    """Figure captions in a text, trimmed, in order."""
    found = F.regexp_extract_all(content, F.lit(CAPTION_PATTERN), 1)
    return F.transform(found, lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))


def image_content(caption: Column, path: Column) -> Column:
    return F.concat(F.lit(CAPTION_MARK), caption, F.lit("\n" + PATH_MARK), path)


def caption_of(content: Column) -> Column:
    return F.regexp_extract(content, CAPTION_MARK.strip() + r"\s*([^\n]*)", 1)


def path_of(content: Column) -> Column:
    return F.trim(F.regexp_extract(content, PATH_MARK.strip() + r"\s*([^\n]+)", 1))


def full_path(path: Column, base: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def snippet(text: Column, limit: int = 100) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def data_uri(image: Column) -> Column:
    return F.concat(F.lit("data:image/jpeg;base64,"), F.base64(image))


def rerank_prompt_kind(query: Column, n_candidates: Column, kind: str = "auto") -> Column:
    """Which rerank prompt a question gets: medical, explanation, advanced or basic."""
    if kind != "auto":
        return F.lit(kind if kind in ("advanced", "explanation", "medical") else "basic")
    medical = F.exists(F.array(*map(F.lit, MEDICAL_WORDS)), lambda w: F.contains(F.lower(query), w))
    return F.when(medical, "medical").when(n_candidates <= 5, "explanation").when(F.length(query) > 20, "advanced").otherwise("basic")


def hash_similarity(a: Column, b: Column) -> Column:
    """1 - differing bits / 128 of the MD5 digests: 1 for equal texts, near a half for others (not locality sensitive)."""
    x, y = F.md5(a), F.md5(b)
    part = lambda h, i: F.conv(F.substring(h, i, 8), 16, 10).cast("bigint")
    bits = sum((F.bit_count(part(x, i).bitwiseXOR(part(y, i))) for i in (1, 9, 17, 25)), F.lit(0))
    return 1 - bits / 128.0
