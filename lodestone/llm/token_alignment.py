"""Cross-tokenizer alignment: a dangling-suffix transducer over the tokens of two tokenizers.

Both encodings of a text spell the same bytes. The transducer takes their tokens in turn and keeps as its state only
which side leads and the bytes of that side's last token that the other has yet to spell (the dangling
suffix). The side behind moves next: its token is linked with the leading token, and either eats of the suffix
or passes it and leads itself. Where nothing dangles both sides end a token at the same byte, and a group closes.
Steps are memoised by suffix and token, so the walk never looks at a text's bytes.

What lies between two stable boundaries is encoded and aligned alike wherever it stands, so each worker walks a stretch once. A boundary
is stable before an ASCII space between two characters that aren't white space: the byte-level splitter begins a
piece there, and no piece of the other vocabulary holds a space after anything but spaces (checked when it is loaded). Within
stretches of Latin letters and ASCII marks the same holds between letters and marks, if no piece mixes them.

The corpus is read once. Each block of texts leaves its stretches' links and its rows; the pairs of a block, each once, are
counted over all blocks by a join, and the counts go back to the block that needs them.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lodestone.llm._spark import Stage

#: Characters of the texts of a block, and of a part of a long text.
BLOCK, PART = 4 << 20, 1 << 20
#: Blocks (about 6 MB each) that a row group of their table holds, and so a task that reads it, however many a task has written.
GROUP = 2
#: Stretches (twice as many at most) and steps that a worker remembers; longer stretches aren't remembered.
MEMO, STEPS, LONG = 200_000, 300_000, 64

#: Characters that some definition of white space holds (others are in Python's own).
_WIDE = "᠎​⁠﻿"
STABLE = re.compile(f"(?<=[^\\s{_WIDE}]) (?=[^\\s{_WIDE}])")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = "\n!-&(-@\\[-`{-~"  # no apostrophe: the splitter has endings that begin with one
PIECES = re.compile(f"[{_LETTERS}]+|[^{_LETTERS}]+")
PLAIN = re.compile(f"[{_LETTERS}{_MARKS}]+")
WORD = re.compile(f"[{_LETTERS}]+")


def _alphabet() -> dict[int, str]:
    """Byte-level alphabet: printable bytes of Latin-1 stand for themselves, the others for the characters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class ByteLevel:
    """Tokens of a byte-level BPE file of the tokenizers library; special strings count as plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        if "ByteLevel" not in str(self.own.pre_tokenizer) or self.own.normalizer is not None:
            raise ValueError(f"not a plain byte-level vocabulary: {path}")
        self.own.encode_special_tokens = True
        self.own.no_truncation()
        self.own.no_padding()
        letters = _alphabet()
        back = {c: b for b, c in letters.items()}
        self.table = str.maketrans({chr(b): c for b, c in letters.items()})
        self.bytes = [b""] * self.own.get_vocab_size()
        for token, i in self.own.get_vocab(with_added_tokens=False).items():
            self.bytes[i] = bytes(back[c] for c in token)
        self.lossless = len({b for b in self.bytes if len(b) == 1}) == 256

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if WORD.fullmatch(text, text[:1] == " "):  # one piece of the splitter, so the model alone encodes it
                out[i] = [t.id for t in self.own.model.tokenize(text.encode().decode("latin-1").translate(self.table))]
            else:
                rest.append(i)
        for i, e in zip(rest, self.own.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out


class Pieces:
    """Tokens of a sentencepiece model that puts a space before a text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_file=path)
        pieces = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else b"" if self.own.is_control(i) or self.own.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        real = [p for i, p in enumerate(pieces) if not (self.own.is_byte(i) or self.own.is_control(i) or self.own.is_unknown(i))]
        #: Whether no piece goes on over a space, and none over a letter and a mark.
        self.by_words = not any(re.search("[^▁]▁", p) for p in real)
        mark = f"[^{_LETTERS}▁]"
        guard = self.own.encode("\n")
        self.by_letters = self.by_words and len(guard) == 2 and not any("\n" in p or re.search(f"[{_LETTERS}]{mark}|{mark}[{_LETTERS}]", p) for p in real)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Tokens of texts that begin with a space (which the model adds) or stand within a word."""
        # a line feed in front keeps the added space away; both are tokens of their own
        got = self.own.encode([t[1:] if t[:1] == " " else "\n" + t for t in texts], num_threads=1)
        return [ids if t[:1] == " " else ids[2:] for t, ids in zip(texts, got)]


class Transducer:
    """Walks two token sequences that spell the same bytes."""

    def __init__(self, left: list[bytes], right: list[bytes]):
        self.vocabulary = (left, right)
        self.names = [str(i) for i in range(max(len(left), len(right)))]
        self.width = len(self.names)
        self._clear()

    def _clear(self) -> None:
        #: suffixes by number, and back; 0 is the empty one, at which groups close; whether the left side leads
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        self.numbers: dict[tuple[int, bytes], int] = {(0, b""): 0, (1, b""): 0}
        self.left_leads = [False]
        self.steps: dict[int, int] = {}

    def _step(self, state: int, token: int) -> int:
        """The state after the side behind has moved (from 0: the left side), or -1 where the bytes differ."""
        lead, suffix = self.states[state]
        side = 1 - lead if state else 0
        spelled = self.vocabulary[side][token]
        if not spelled or not (spelled.startswith(suffix) or suffix.startswith(spelled)):
            to = -1
        else:
            key = (side, spelled[len(suffix) :]) if len(spelled) > len(suffix) else (lead, suffix[len(spelled) :])
            to = self.numbers.get(key)
            if to is None:
                to = self.numbers[key] = len(self.states)
                self.states.append(key)
                self.left_leads.append(key[0] == 0)
        self.steps[state * self.width + token] = to
        return to

    def walk(self, left: list[int], right: list[int]) -> tuple[int, str, list[int]] | None:
        """Number of groups, the groups as text, and the links as pairs of ids; None if the sequences spell different bytes."""
        if len(self.steps) > STEPS:
            self._clear()
        known, leads, width, names = self.steps.get, self.left_leads, self.width, self.names
        i = j = state = groups = 0
        n, m = len(left), len(right)
        mine = theirs = ""  # the open group on both sides
        text, links = [], []
        while i < n or j < m:
            if leads[state]:
                if j == m:
                    return None
                token = right[j]
                j += 1
                theirs = f"{theirs},{names[token]}" if theirs else names[token]
                links.append(left[i - 1] << 32 | token)
            else:
                if i == n:
                    return None
                token = left[i]
                i += 1
                mine = f"{mine},{names[token]}" if mine else names[token]
                if state:
                    links.append(token << 32 | right[j - 1])
            to = known(state * width + token)
            state = self._step(state, token) if to is None else to
            if state <= 0:
                if state:
                    return None
                groups += 1
                text.append(f"{mine}|{theirs}")
                mine = theirs = ""
        return None if state else (groups, ";".join(text), links)


_ABSENT = object()


class _Recent(dict):
    """What was asked for lately: at MEMO entries the older half is put behind, and forgotten at the next turn unless asked for."""

    old: dict = {}

    def __missing__(self, key):
        found = self.old.get(key, _ABSENT)
        if found is not _ABSENT:
            self[key] = found
        return found

    def turn(self) -> None:
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()


class Aligner:
    """Aligned stretches, remembered: (left tokens, right tokens, groups, groups as text, links), or None where the two spell other bytes."""

    def __init__(self, left_path: str, right_path: str):
        self.left, self.right = ByteLevel(left_path), Pieces(right_path)
        self.transducer = Transducer(self.left.bytes, self.right.bytes)
        #: stretches and their beginnings (after a space), and what goes on within a stretch
        self.memo, self.inner = _Recent(), _Recent()

    def _unit(self, text: str, a: list[int], b: list[int]) -> tuple | None:
        walked = self.transducer.walk(a, b)
        # a vocabulary with all bytes spells any text; otherwise the tokens must spell this one, not only each other
        if walked is None or not self.left.lossless and b"".join([self.left.bytes[t] for t in a]) != text.encode():
            return None
        groups, named, links = walked
        return len(a), len(b), groups, named, array("q", links).tobytes()

    def stretches(self, texts: list[str]) -> list[tuple | None]:
        """Of each stretch (without the space in front) its alignment."""
        memo, inner, plain, letters = self.memo, self.inner, PLAIN.fullmatch, self.right.by_letters
        memo.turn()
        inner.turn()
        out = [memo[t] for t in texts]
        cut: list[tuple[int, list[str]]] = []
        heads: dict[str, tuple | None] = {}
        others: dict[str, tuple | None] = {}
        for k, one in enumerate(out):
            if one is not _ABSENT:
                continue
            text = texts[k]
            parts = [text]
            # of two line feeds the splitter treats the second by what follows
            if letters and not text.isalpha() and "\n\n" not in text and plain(text):
                parts = PIECES.findall(text)
            cut.append((k, parts))
            if memo[parts[0]] is _ABSENT:
                heads[parts[0]] = None
            for p in parts[1:]:
                if inner[p] is _ABSENT:
                    others[p] = None
        for fresh, known, space in ((heads, memo, " "), (others, inner, "")):
            new = list(fresh)
            for i in range(0, len(new), 4096):
                some = new[i : i + 4096]
                spelled = [space + p for p in some]
                for p, t, a, b in zip(some, spelled, self.left.encode(spelled), self.right.encode(spelled)):
                    fresh[p] = one = self._unit(t, a, b)
                    if len(p) <= LONG:
                        known[p] = one
        for k, parts in cut:
            done = [heads[parts[0]] if parts[0] in heads else memo[parts[0]]]
            if len(parts) > 1:
                done += [others[p] if p in others else inner[p] for p in parts[1:]]
                if None in done:
                    done = [None]
                else:
                    a, b, g, named, links = zip(*done)
                    done = [(sum(a), sum(b), sum(g), ";".join(named), b"".join(links))]
                if len(texts[k]) <= LONG:
                    memo[texts[k]] = done[0]
            out[k] = done[0]
        return out

    def parts(self, text: str) -> Iterator[str]:
        """A long text in parts that end before a stable boundary; the space there belongs to neither."""
        at = 0
        while self.right.by_words and len(text) - at > PART:
            found = STABLE.search(text, at + PART)
            if not found:
                break
            yield text[at : found.start()]
            at = found.end()
        yield text[at:]

    def block(self, texts: list[str]) -> tuple[list[tuple | None], list[list[int]]]:
        """Alignments of the distinct stretches of some texts (not empty), and each text as numbers of stretches."""

        class Numbers(dict):
            def __missing__(self, key):
                n = self[key] = len(self)
                return n

        numbers = Numbers()
        number = numbers.__getitem__
        if not self.right.by_words:
            ids = [[number(t)] for t in texts]
            return self.stretches(list(numbers)), ids
        ids = [list(map(number, t.split(" "))) for t in texts]
        # a space beside white space or at an end of the text is no boundary
        edge = np.fromiter((not w or w[0].isspace() or w[-1].isspace() or w[0] in _WIDE or w[-1] in _WIDE for w in numbers), bool, len(numbers))
        if edge.any():
            ids = [list(map(number, STABLE.split(t))) if edge[i].any() else i for t, i in zip(texts, ids)]
        used = np.zeros(len(numbers), dtype=bool)
        for i in ids:
            used[i] = True
        keys = list(numbers)
        at = np.flatnonzero(used).tolist()
        done: list[tuple | None] = [None] * len(keys)
        for i, one in zip(at, self.stretches([keys[i] for i in at])):
            done[i] = one
        return done, ids


def _block_type(id_type: pa.DataType) -> pa.Schema:
    row = pa.struct([("row", pa.int64()), ("id", id_type), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("sha", pa.string())])
    return pa.schema([("block", pa.int64()), ("rows", pa.list_(row)), ("parts", pa.list_(pa.int64())), ("sizes", pa.binary()), ("stretches", pa.binary()), ("lengths", pa.binary()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def _packed(x) -> bytes:
    return np.asarray(x, dtype=np.int32).tobytes()


def _encoder(left_path: str, right_path: str, id_type: pa.DataType):
    schema = _block_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = Aligner(left_path, right_path)
        base = TaskContext.get().partitionId() << 33
        ordinal = blocks = 0
        held: list[tuple[int, object, str, bool]] = []  # row, id, part of its text, whether it is the last
        size = 0
        sums: dict[int, list] = {}  # of a long text whose parts are not all done

        def flush() -> pa.RecordBatch:
            nonlocal blocks
            full = [k for k, h in enumerate(held) if h[2]]
            done, ids = aligner.block([held[k][2] for k in full])
            wrong = {i for one in ids for i in set(one) if done[i] is None} if None in done else ()
            if wrong:
                fits = [wrong.isdisjoint(one) for one in ids]
                full, ids = [k for k, f in zip(full, fits) if f], [one for one, f in zip(ids, fits) if f]
            flat = np.array([i for one in ids for i in one], dtype=np.int64)
            stop = np.cumsum([0, *map(len, ids)])
            totals = []
            for c in range(3):
                run_ = np.concatenate([[0], np.cumsum(np.array([d[c] if d else 0 for d in done], dtype=np.int64)[flat])])
                totals.append(np.diff(run_[stop]).tolist())
            words = [d[3] if d else "" for d in done]
            at = dict(zip(full, range(len(full))))
            lines = []
            for k, (row, key, _, last) in enumerate(held):
                n = sums.setdefault(row, [0, 0, 0, hashlib.sha256(), False])
                if k in at:
                    for c in range(3):
                        n[c] += totals[c][at[k]]
                    n[3].update(((";" if n[4] else "") + ";".join([words[i] for i in ids[at[k]]])).encode())
                    n[4] = True
                if last:
                    lines.append({"row": row, "id": key, "n_a": n[0], "n_b": n[1], "n_groups": n[2], "n_links": n[0] + n[1] - n[2], "sha": n[3].hexdigest() if n[4] else ""})
                    del sums[row]
            weight = np.bincount(flat, minlength=len(done))
            used = np.flatnonzero(weight)
            place = np.zeros(len(done), dtype=np.int64)
            place[used] = np.arange(len(used))
            raw = [done[i][4] for i in used.tolist()]
            lengths = np.array([len(r) >> 3 for r in raw], dtype=np.int64)
            pairs, links = np.unique(np.frombuffer(b"".join(raw), dtype=np.int64), return_inverse=True)
            counts = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(counts, links, np.repeat(weight[used], lengths))
            out = [[base + blocks], [lines], [[held[k][0] for k in full]], [_packed(np.diff(stop))], [_packed(place[flat])], [_packed(lengths)], [_packed(links)]]
            made = pa.record_batch([*(pa.array(v, t) for v, t in zip(out, schema.types)), pa.ListArray.from_arrays([0, len(pairs)], pa.array(pairs)), pa.ListArray.from_arrays([0, len(pairs)], pa.array(counts))], schema=schema)
            blocks += 1
            held.clear()
            return made

        for rb in batches:
            for key, text in zip(rb.column(0), rb.column(1)):
                row, text = base + ordinal, text.as_py() or ""
                ordinal += 1
                parts = list(aligner.parts(text))
                if len(parts) > 1 and any(None in aligner.block([p])[0] for p in parts):
                    parts = [""]  # one part spells other bytes: the text has no tokens
                for p in parts[:-1]:
                    held.append((row, None, p, False))
                    yield flush()
                held.append((row, key.as_py(), parts[-1], True))
                size += len(parts[-1])
                if size >= BLOCK or len(held) >= 1 << 16:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _judge(schema: pa.Schema):
    """Of each part of a text its best links and the sum of their counts; the counts of a block's pairs come beside the block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.to_pylist()[0] if left.num_rows else None
        if block is None:
            return schema.empty_table()
        place = right.column("at").to_numpy()
        count, best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        count[place] = right.column("count").to_numpy()
        best[place] = right.column("best").to_numpy()
        get = lambda name: np.frombuffer(block[name], dtype=np.int32)
        links, ends = get("links"), np.concatenate([[0], np.cumsum(get("lengths"), dtype=np.int64)])
        sums = []
        for value in (best, count):
            run_ = np.concatenate([[0], np.cumsum(value[links])])
            per = (run_[ends[1:]] - run_[ends[:-1]])[get("stretches")]
            run_ = np.concatenate([[0], np.cumsum(per)])
            stop = np.cumsum(get("sizes"), dtype=np.int64)
            sums.append(run_[stop] - run_[stop - get("sizes")])
        rows = pa.Table.from_arrays([pa.array(block["parts"], pa.int64()), *(pa.array(s, pa.int64()) for s in sums)], ["row", "n_best", "count_sum"])
        return rows.cast(schema)

    return run


def align_tokens(docs: DataFrame, left_path: str, right_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row.

    A: space and text by the byte-level BPE file at left_path, B: the text by the sentencepiece model at right_path, which adds
    the space; no special tokens, their strings are plain text. Byte offsets where tokens of both end cut them into groups; a link is a pair
    of occurrences whose bytes overlap. n_best: links whose pair of ids is linked, over all rows, as often as any pair
    of that B id; count_sum: those numbers over the row's links; groups_sha256: lower-case hex digest of the groups
    written `a1,a2|b1;a3|b2,b3`. A null or empty text, and one whose tokens spell other bytes, has no
    tokens: zeros and an empty digest. Repeated rows count each, null ids are kept, other columns aren't read, no rows give
    no rows.
    """
    stage = Stage(docs.sparkSession, "alignment")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = f"block long, rows array<struct<row: long, id: {kind}, n_a: long, n_b: long, n_groups: long, n_links: long, sha: string>>, parts array<long>, sizes binary, stretches binary, lengths binary, links binary, pairs array<long>, counts array<long>"
    from pyspark.sql.pandas.types import to_arrow_type

    blocks = stage.save(rows.mapInArrow(_encoder(left_path, right_path, to_arrow_type(rows.schema["id"].dataType)), made), "blocks", GROUP)
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count"))
    pairs = stage.save(pairs.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "pairs")
    # a row for each id of the right vocabulary at most
    most = F.broadcast(pairs.groupBy("b").agg(F.max("count").alias("most")))
    counted = pairs.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    asked = blocks.select("block", F.posexplode("pairs").alias("at", "pair")).join(counted, "pair").select("block", "at", "count", "best")
    packed = blocks.select(F.col("block").alias("home"), "parts", "sizes", "stretches", "lengths", "links")
    schema = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])
    judged = packed.groupBy("home").cogroup(asked.groupBy("block")).applyInArrow(_judge(schema), "row long, n_best long, count_sum long")
    judged = judged.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    lines = blocks.select(F.explode("rows").alias("r")).select("r.*").join(judged, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return lines.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), F.col("sha").alias("groups_sha256"))
