"""Personal data: fixed patterns, and terms that reveal what is protected. DataFrame and SQL functions only.

Four kinds are found by pattern. Beyond them, co-occurrence over the whole corpus estimates what a term (a run of letters
and digits, lowered) discloses, and terms over a threshold are spans of kind `term`. Two sorts of entity are protected:

* A value e that a pattern found. Over contexts (sentences of lines), PMI(t; e) = log2(n_te N / (n_t n_e)) against
  the value's own information IC(e) = log2(N / n_e). A term discloses e with PMI >= DISCLOSES * IC, if the evidence is
  sure: contexts count as one where they agree in a sketch of their words (near copies do), and of the k unlike
  ones in which both stand, scaled to all that hold the term, the lower end of the 95 % interval of P(e | t) must be SURE at
  least. A word met once or twice beside a value is no evidence. Both tests are the same for a table and for
  copies of it. The term is a span wherever it stands in a text that holds e.
* The holder of a text, whom a key or a password reveals although it occurs but once, so that its own count says nothing.
  IC(t) = -log2 P(t) is estimated from how characters co-occur as neighbours in all words of the corpus, a word
  counting log2(1 + its contexts), so that neither copies nor once-seen words rule; and it is no more than what choosing
  each character evenly takes. A term of HOLDER bits or more, so that not two texts in 2**(HOLDER / 2) share it by
  chance, whose bits a character also exceed the corpus's mean by UNLIKE, is a span in every text.

Sanitising puts a kind's name for a pattern's span and <ID> for a term of the second sort (generalised), and removes
those of the first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.llm._spark import Stage

#: Share of a value's information that a term may disclose, least lower bound of P(value | term), characters of such a term.
DISCLOSES, SURE, LETTERS = 0.5, 0.5, 3
#: Quantile of the bound (95 %), words of a context's sketch.
Z, SKETCH = 1.96, 3
#: Bits that reveal a holder, and bits a character over the mean of the corpus that they must have.
HOLDER, UNLIKE = 64, 1.4
#: Terms, or rows with their terms, that are broadcast at most (about 100 bytes each in an executor); beyond, they are joined by a shuffle.
MOST_TERMS = 500_000
#: What ends a context, and a word.
CONTEXT, WORD = r"\n|(?<=[.!?])[ \t]", r"[\p{L}\p{N}]+"
#: Characters beyond these count as one in the model of words, so that it has at most 600 ** 2 pairs.
OTHER = r"[^\x{0}-\x{24F}]"

# Java forms of the patterns. Possessive loops run without recursion and never give back what they took, which changes
# no match here: what follows each loop cannot begin with what it takes. A local part or a first number can
# only begin where its run of characters does, or where the last match ended (\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that must hold for a text to have a match at all.
HINTS = {"email": "contains({t}, '@')", "ip": "rlike({t}, '[0-9][.][0-9]')", "card": "rlike({t}, '[0-9][0-9 -]{{15}}')", "phone": "contains({t}, '+')"}
_BYTE = "^0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
_LUHN = "aggregate(sequence(1, length(d)), 0, (s, i) -> s + case when i % 2 = 1 then int(substr(d, -i, 1)) else int(substr('0246813579', int(substr(d, -i, 1)) + 1, 1)) end) % 10 = 0"
CHECKS = {
    "email": "true",
    "ip": f"forall(split(m, '[.]'), p -> rlike(p, '{_BYTE}'))",
    "card": "exists(array(translate(m, ' -', '')), d -> case when length(d) between 16 and 19 then " + _LUHN + " else false end)",
    "phone": "length(regexp_replace(m, '[^0-9]', '')) between 8 and 15",
}


def _literal(pattern: str) -> str:
    return "r'" + pattern + "'"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _before(sizes: str) -> str:
    """array<int>: what stands before each element of an array of sizes, summed over blocks of 64 so that long arrays aren't copied for each element."""
    blocks = "transform(sequence(0, int((size(l) - 1) div 64)), i -> aggregate(slice(l, i * 64 + 1, 64), 0, (s, x) -> s + x))"
    starts = f"aggregate({blocks}, named_struct('at', 0, 'all', cast(array() as array<int>)), (a, x) -> named_struct('at', a.at + x, 'all', array_append(a.all, a.at)), a -> a.all)"
    each = f"flatten(transform({starts}, (s, i) -> transform(slice(l, i * 64 + 1, 64), (x, j) -> s + aggregate(slice(l, i * 64 + 1, j), 0, (t, y) -> t + y))))"
    return _let(sizes, "l", f"case when size(l) = 0 then cast(array() as array<int>) else {each} end")


def _matches(text: str, pattern: str) -> str:
    """array<struct<start, m>> of a pattern's matches, in time that grows with the text."""
    parts = f"zip_with(split({text}, {_literal(pattern)}, -1), regexp_extract_all({text}, {_literal(pattern)}, 0), (gap, m) -> named_struct('gap', length(gap), 'm', m))"
    sizes = _before("transform(parts, x -> x.gap + coalesce(length(x.m), 0))")
    return f"filter({_let(parts, 'parts', f"zip_with(parts, {sizes}, (x, at) -> named_struct('start', at + x.gap, 'm', x.m))")}, x -> x.m is not null)"


def base_spans(text: str) -> Column:
    """array<struct<kind, start, end, value>> of the text column, by kind as listed, then start; code points from 0, end exclusive."""
    parts = []
    for kind, pattern in PATTERNS.items():
        held = f"filter({_matches(text, pattern)}, x -> exists(array(x.m), m -> {CHECKS[kind]}))"
        walk = f"transform({held}, x -> named_struct('kind', '{kind}', 'start', x.start, 'end', x.start + length(x.m), 'value', x.m))"
        parts.append(f"case when {HINTS[kind].format(t=text)} then {walk} else cast(array() as array<struct<kind: string, start: int, end: int, value: string>>) end")
    return F.expr(f"concat({', '.join(parts)})")


#: What is no word of a text: matches of the patterns that stand as whole words, whether they hold or not.
MASKS = {
    "email": PATTERNS["email"],
    "ip": r"(?<![\p{L}\p{N}])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])[0-9]++(?:[\x20-][0-9]++)*+(?![\p{L}\p{N}])",
    "phone": r"\+[0-9]++(?:[\x20().-]++[0-9]++)*+(?![\p{L}\p{N}])",
}


def words_of(text: str) -> str:
    """Distinct lowered words outside the masks."""
    masked = text
    for kind, pattern in MASKS.items():
        masked = f"case when {HINTS[kind].format(t=text)} then regexp_replace({masked}, {_literal(pattern)}, ' ') else {masked} end"
    return f"array_distinct(transform(regexp_extract_all({masked}, {_literal(WORD)}, 0), w -> lower(w)))"


_NONE = "cast(array() as array<struct<start: int, end: int, id: boolean>>)"
_HINTED = "({})".format(" or ".join(HINTS.values()))
_LONG = f"size(array_distinct(split(w, ''))) > 1 and length(w) >= {math.ceil(HOLDER / math.log2(36))}"


def term_spans(text: str, base: str, terms: str) -> str:
    """array<struct<start, end, id>> of the words that are among the terms (struct<term, id>) and not within a base span; a word is looked up among those of its hash."""
    by_hash = f"transform(sequence(0, 63), b -> filter({terms}, t -> pmod(hash(t.term), 64) = b))"
    mine = "filter(element_at(dealt, 1 + pmod(hash(lower(x.m)), 64)), t -> t.term = lower(x.m))"
    known = f"filter(transform({_matches(text, WORD)}, x -> named_struct('start', x.start, 'end', x.start + length(x.m), 'hits', {mine})), x -> size(x.hits) > 0)"
    free = f"filter({known}, x -> not exists({base}, b -> b.start <= x.start and x.end <= b.end))"
    return _let(by_hash, "dealt", f"transform({free}, x -> named_struct('start', x.start, 'end', x.end, 'id', exists(x.hits, t -> t.id)))")


def _few(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it is within the bound."""
    return F.broadcast(table) if table.limit(MOST_TERMS + 1).count() <= MOST_TERMS else table


class _Disclosure:
    """What the corpus discloses. texts: (key, text), text not null; a row is known by what it holds."""

    def __init__(self, spark: SparkSession, texts: DataFrame):
        self.stage, self.texts, self.counted = Stage(spark, "pii"), texts, None

    def words(self) -> DataFrame:
        """(word, n): the contexts that each word of the corpus is in."""
        if self.counted is None:
            contexts = self.texts.select(F.explode(F.split("text", CONTEXT)).alias("line"))
            words = contexts.select(F.explode(F.expr(words_of("line"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
            self.counted = self.stage.save(words, "words")
        return self.counted

    def of_values(self) -> DataFrame:
        """(key, term) of the terms that disclose a value which the text holds."""
        stage, line = self.stage, F.explode(F.split("text", CONTEXT)).alias("line")
        lines = self.texts.where(_HINTED.format(t="text")).select("key", line).where(_HINTED.format(t="line"))
        lines = lines.withColumn("values", F.array_distinct(F.transform(base_spans("line"), lambda x: x["value"]))).where("size(values) > 0")
        sketch = F.expr(f"slice(array_sort(transform(filter({words_of('line')}, w -> w rlike '^\\\\p{{L}}+$'), w -> xxhash64(w))), 1, {SKETCH})")
        lines = stage.save(lines.withColumn("sketch", F.xxhash64(sketch)), "lines")
        on = lines.select("key", "line", "sketch", F.explode("values").alias("value"))
        words = F.explode(F.expr(f"filter({words_of('line')}, w -> length(w) >= {LETTERS})")).alias("term")
        pairs = on.select("value", "sketch", words).groupBy("value", "term", "sketch").agg(F.count("*").alias("n"))
        pairs = stage.save(pairs.groupBy("value", "term").agg(F.sum("n").alias("n_te"), F.count("*").alias("k")), "pairs")
        total = float(self.texts.agg(F.sum(F.size(F.split("text", CONTEXT)))).first()[0] or 0)
        # all words are counted already; the few that stand beside a value are looked up
        terms = stage.save(pairs.select("term").distinct(), "terms")
        counts = self.words().join(_few(terms), F.col("word") == F.col("term")).select("term", F.col("n").alias("n_t"))
        values = on.groupBy("value").agg(F.count("*").alias("n_e"))
        scored = pairs.join(counts, "term").join(values, "value").withColumn("ic", F.log2(F.lit(total) / F.col("n_e"))).withColumn("pmi", F.log2(F.col("n_te") * F.lit(total) / (F.col("n_t") * F.col("n_e"))))
        # Wilson's lower bound of P(value | term) from k unlike contexts of as many as the term would then have
        share, m = F.col("n_te") / F.col("n_t"), F.col("k") * F.col("n_t") / F.col("n_te")
        sure = (share + Z * Z / (2 * m) - Z * F.sqrt(share * (1 - share) / m + Z * Z / (4 * m * m))) / (1 + Z * Z / m)
        disclosing = stage.save(scored.where("ic > 0").where((F.col("pmi") >= DISCLOSES * F.col("ic")) & (sure >= SURE)).select("value", "term", "pmi", "ic"), "disclosing")
        return on.select("key", "value").join(_few(disclosing.select("value", "term")), "value").select("key", "term").distinct()

    def model(self, words: DataFrame) -> DataFrame:
        """(pair, n, cost) of neighbouring characters of the words (word, n), ends included; cost: bits of the second after the first."""
        pairs = words.select(_pairs("word"), F.round(F.log2(F.col("n") + 1) * 1024).cast("long").alias("n"))
        pairs = self.stage.save(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "model")
        firsts = pairs.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("of"))
        kinds = firsts.count() + 1
        cost = -F.log2((F.col("n") + 1024) / (F.col("of") + 1024 * kinds))
        return pairs.withColumn("first", F.substring("pair", 1, 1)).join(F.broadcast(firsts), "first").select("pair", "n", cost.alias("cost"))  # 600 rows

    def of_holders(self) -> DataFrame:
        """(word, bits) of the terms that disclose the holder of a text."""
        stage, words = self.stage, self.words()
        costs = stage.save(self.model(words), "costs")
        mean = costs.agg(F.sum(F.col("n") * F.col("cost")) / F.sum("n")).first()[0] or 0.0
        long = words.where(_LONG.replace("w", "word")).select("word", _pairs("word"))
        bits = long.join(F.broadcast(costs), "pair").groupBy("word").agg(F.sum("cost").alias("bits"), F.count("*").alias("size"))
        even = F.expr("length(word) * log2((case when word rlike '[0-9]' then 10 else 0 end) + (case when word rlike '[^0-9]' then 26 else 0 end))")
        found = bits.where((F.least("bits", even) >= HOLDER) & (F.col("bits") >= UNLIKE * mean * F.col("size"))).select("word", "bits")
        return stage.save(found, "holders")

    def terms(self) -> DataFrame:
        """(key, terms): the terms (struct<term, id>) of each text that has any; id: whether it discloses the holder."""
        words = F.explode(F.expr(f"filter({words_of('text')}, w -> {_LONG})")).alias("word")
        held = self.texts.select("key", words).join(_few(self.of_holders()), "word").select("key", F.col("word").alias("term"), F.lit(True).alias("id"))
        every = self.of_values().withColumn("id", F.lit(False)).unionByName(held)
        return self.stage.save(every.groupBy("key").agg(F.collect_set(F.struct("term", "id")).alias("terms")), "hits")


def _pairs(word: str) -> Column:
    """The neighbouring characters of ^word$, one pair a row."""
    chars = f"split(concat('^', regexp_replace({word}, {_literal(OTHER)}, '\u4e00'), '$'), '')"
    return F.explode(F.expr(f"zip_with(slice({chars}, 1, length({word}) + 1), slice({chars}, 2, length({word}) + 1), (a, b) -> concat(a, b))")).alias("pair")


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row of docs as struct `row` with its text, its base spans and the spans of its terms."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.withColumn("text", F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))).withColumn("key", F.xxhash64(f"row.`{id_col}`", "text"))
    hits = _few(_Disclosure(docs.sparkSession, rows.select("key", "text")).terms())
    rows = rows.join(hits, "key", "left").withColumn("base", base_spans("text"))
    return rows.withColumn("terms", F.expr(f"case when terms is not null then {term_spans('text', 'base', 'terms')} else {_NONE} end"))


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, n_spans) for each row of docs.

    spans: kind:start:end, comma-joined, the patterns' by kind as listed, then start, then the terms'. A null or empty
    text has none (base_sha256 is that of the empty string). Null ids and repeated rows are kept, each with its
    spans; rows that agree in id and text have the same ones. Other columns aren't read. No rows give no rows.
    """
    rows = _found(docs.select(id_col, text_col), id_col, text_col)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in PATTERNS]
    every = F.expr(_joined("concat(transform(base, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end)), transform(terms, s -> named_struct('kind', 'term', 'start', s.start, 'end', s.end)))")).alias("spans")
    return rows.select(F.col(f"row.`{id_col}`").alias(id_col), *counts, F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"), every, F.size("terms").cast("long").alias("n_term"), (F.size("base") + F.size("terms")).cast("long").alias("n_spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with personal data out of its text: a pattern's span becomes <EMAIL>, <IP>, <CARD> or <PHONE>, a term that discloses a holder <ID>; one that discloses a value goes.

    Overlapping spans become the name of the first. A null text stays null; rows without spans stay as they are. Other
    columns, whatever their names, are carried along. Null ids and repeated rows are kept; no rows give no rows.
    """
    out = _found(docs, id_col, text_col)
    touched = F.expr("size(base) + size(terms) > 0")
    once = out.withColumn("touched", touched).withColumn("clean", F.when(F.col("touched"), _cleaned("text")))
    # a match that had run into another, as a card's digits after an address's, stands free only now
    again = once.withColumn("base", F.when(F.col("touched"), base_spans("clean"))).withColumn("terms", F.expr(_NONE))
    text = F.when(F.col("touched"), _cleaned("clean")).otherwise(F.col(f"row.`{text_col}`"))
    return again.withColumn("clean", text).select(*[F.col("clean").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _cleaned(text: str) -> Column:
    """The text with its base spans as names, its terms as <ID> or left out."""
    spans = "array_sort(concat(transform(base, s -> named_struct('start', s.start, 'end', s.end, 'name', concat('<', upper(s.kind), '>'))), transform(terms, s -> named_struct('start', s.start, 'end', s.end, 'name', case when s.id then '<ID>' else '' end))))"
    return F.expr(
        f"aggregate({spans}, named_struct('at', 0, 'out', ''), (a, s) -> case when s.start < a.at then named_struct('at', greatest(a.at, s.end), 'out', a.out) "
        f"else named_struct('at', s.end, 'out', concat(a.out, substr({text}, a.at + 1, s.start - a.at), s.name)) end, a -> concat(a.out, substr({text}, a.at + 1)))"
    )
