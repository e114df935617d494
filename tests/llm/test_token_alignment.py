"""Token alignment against a plain version that encodes whole texts and compares byte ranges."""

import collections
import hashlib
import json
import random

import public_tokenizers
import pytest

from lodestone.llm import token_alignment
from lodestone.llm.queries import op11_token_alignment
from lodestone.llm.token_alignment import Aligner, Transducer, align_tokens

LEFT, RIGHT = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(LEFT), SentencePieceProcessor(model_file=RIGHT)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, n = {b: chr(b) for b in printable}, 0
    for byte in range(256):
        if byte not in letters:
            letters[byte], n = chr(256 + n), n + 1
    back = {c: byte for byte, c in letters.items()}
    names = {i: bytes(back[c] for c in t) for t, i in json.load(open(LEFT))["model"]["vocab"].items()}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def ranges(tokens, spell):
        at, out = 0, []
        for t in tokens:
            out.append((t, at, at + len(spell(t))))
            at = out[-1][2]
        return out

    def align(texts):
        each = []
        for text in texts:
            if not text:
                each.append(None)
                continue
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            want = (" " + text).encode()
            if b"".join(names[t] for t in x) != want or b"".join(piece(t) for t in y) != want:
                each.append(None)
                continue
            x, y = ranges(x, names.get), ranges(y, piece)
            ends = sorted({e for _, _, e in x} & {e for _, _, e in y})
            groups, links, low = [], [], 0
            for end in ends:
                p, q = [t for t in x if low <= t[1] < end], [t for t in y if low <= t[1] < end]
                groups.append(",".join(str(t[0]) for t in p) + "|" + ",".join(str(t[0]) for t in q))
                links += [(s[0], t[0]) for s in p for t in q if s[1] < t[2] and t[1] < s[2]]
                low = end
            each.append((len(x), len(y), groups, links))
        count = collections.Counter(link for e in each if e for link in e[3])
        most = collections.defaultdict(int)
        for (_, t), n in count.items():
            most[t] = max(most[t], n)
        return [(0, 0, 0, 0, 0, 0, "") if e is None else (e[0], e[1], len(e[2]), len(e[3]), sum(count[k] == most[k[1]] for k in e[3]), sum(count[k] for k in e[3]), hashlib.sha256(";".join(e[2]).encode()).hexdigest()) for e in each]

    return align


def got(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "  a  b  ", "a\n\nb", "a\n\n\nb c", "word.\n\nNext", "tab\tbetween", "x \n y", "it's we'll 'twas l'été d'un", "<|endoftext|>", "a<s>b </s> <unk> <0x41>", "▁", "a▁b", "fine then ▁ not", "中文 字符，测试", "emoji 👩‍👩‍👧 é́ ﬁ ½",
    " nbsp  x", "zero​width ​ x", "\x00nul \x1c sep", "1234567 12.5% 3,000", "CamelCaseWord-with_marks(and)[more]{x}", "....!!!??? ---", "http://a.b/c?d=e#f", "Ünïcödé straße × ÷", "a" * 300, "ab " * 400, " line para", "x\r\ny \r\n z", "﻿bom first",
]


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["the", "Maison", "étrange", "über", "3.14", "l'eau", "foo.\nBar", "end.\n\nStart", "x,y", "don't", "(see)", "naïveté", "straße", "supercalifragilistic", "中文字", "''", "a\tb"]
    return ODD + [rng.choice([" ", " ", "  ", "\n", " \n"]).join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(60)] + ["the cat sat"] * 5


@pytest.mark.parametrize("part, block, memo", [(1 << 20, 4 << 20, 150_000), (30, 60, 10)])
def test_equals_whole_texts(spark, monkeypatch, plain, part, block, memo):
    """With the production sizes, and with texts cut into parts, many blocks and a memory of ten stretches."""
    for name, value in (("PART", part), ("BLOCK", block), ("MEMO", memo)):
        monkeypatch.setattr(token_alignment, name, value)
    rows = [(i if i % 11 else None, t) for i, t in enumerate(corpus())] + [(7, "a")] * 2
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, row int, id string")
    want = sorted((str(i), *w) for (i, _), w in zip(rows, plain([t for _, t in rows])))
    assert got(align_tokens(df, LEFT, RIGHT)) == want


def test_no_rows(spark):
    assert align_tokens(spark.createDataFrame([], "doc_id long, text string"), LEFT, RIGHT).collect() == []


def test_transducer():
    t = Transducer([b"ab", b"c", b"abcd", b"e"], [b"a", b"bcd", b"abcde", b"b", b"x"])
    pair = lambda a, b: a << 32 | b
    assert t.walk([2, 3], [0, 1]) is None  # the right side ends early
    assert t.walk([0, 1], [0, 3]) is None
    assert t.walk([2, 3], [2]) == (1, "2,3|2", [pair(2, 2), pair(3, 2)])
    assert t.walk([2], [0, 1]) == (1, "2|0,1", [pair(2, 0), pair(2, 1)])
    assert t.walk([0, 0], [0, 3, 0, 3]) == (2, "0|0,3;0|0,3", [pair(0, 0), pair(0, 3)] * 2)
    assert t.walk([0], [4]) is None and t.walk([], []) == (0, "", [])
    before = dict(t.steps)
    t.walk([2], [0, 1])
    assert t.steps == before


def test_long_texts_have_one_alignment(plain):
    """A text of many parts, and one without any boundary, are aligned as wholes."""
    aligner = Aligner(LEFT, RIGHT)
    for text in ("some wörds, again. " * 3000, "x" * 5000):
        done, ids = aligner.block([text])
        found = [done[i] for i in ids[0]]
        n_a, n_b, n_groups = plain([text])[0][:3]
        assert (sum(f[0] for f in found), sum(f[1] for f in found), sum(f[2] for f in found)) == (n_a, n_b, n_groups)


def test_query_equals_plain(spark, sf_dir, plain):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), *w) for r, w in zip(rows, plain([r.text for r in rows])))
    assert got(op11_token_alignment(spark, sf_dir)) == want


def test_blocks_lie_in_small_row_groups(spark, monkeypatch, tmp_path):
    """However many blocks a task writes, a reader holds GROUP of them: a text of six parts makes six blocks in one file."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr("lodestone.llm._spark.shared_dir", lambda spark: str(tmp_path))
    long = ("word and other words " * (6 * token_alignment.PART // 21)).strip()
    rows = align_tokens(spark.createDataFrame([(1, long)], "doc_id long, text string").coalesce(1), LEFT, RIGHT).collect()
    assert len(rows) == 1 and rows[0].n_links > 0
    groups = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/lodestone/*/alignment-*/blocks/*.parquet")]
    assert max(m.num_rows for m in groups) > token_alignment.GROUP
    assert all(m.row_group(i).num_rows <= token_alignment.GROUP for m in groups for i in range(m.num_row_groups))
