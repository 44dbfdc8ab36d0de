"""Alignment of two tokenizers against a plain version: whole texts, every token span, every overlapping pair."""

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidegate.llm import alignment, encoding, queries

BYTES, PIECES = encoding.vocabulary(), encoding.vocabulary("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  two  spaces ", "a", " a b", "x\ny z\t\n w", "tab\t space \n\n end ", "É è ünï 漢字かな 😀 end", "<|endoftext|> a <s> b </s> <unk> <0x41>", "half ▁ mark", "x▁ y", "'s it's we'll ''ll 5's", "a b  c \x1c d\x85e",
    "１２ ﬁ ① Å Å é ́x", "nul \x00 byte", "r" * 2500 + " z", "word " * 3000, "end with space ", "​ zero ﻿ width", "a  b   c    d", "same text again", "same text again",
]


@pytest.fixture(scope="module")
def plain():
    a_file = Tokenizer.from_file(BYTES)
    a_file.encode_special_tokens = True
    b_file = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in visible)}

    def tokens(text):
        a = a_file.encode(" " + text, add_special_tokens=False).ids
        b = b_file.encode(text)
        a_bytes = [bytes(letters[c] for c in a_file.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_file.id_to_piece(i)[3:5], 16)]) if b_file.is_byte(i) else b_file.id_to_piece(i).replace("▁", " ").encode() for i in b]
        return (a, b, a_bytes, b_bytes) if b"".join(a_bytes) == (" " + text).encode() == b"".join(b_bytes) else None

    def spans(pieces):
        at, out = 0, []
        for p in pieces:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    def align(texts):
        rows, count = [], Counter()
        for t in texts:
            found = tokens(t) if t else None
            if not found:
                rows.append(None)
                continue
            a, b, a_spans, b_spans = found[0], found[1], spans(found[2]), spans(found[3])
            cuts = sorted({e for _, e in a_spans} & {e for _, e in b_spans})
            inside = lambda ids, where, low, high: ",".join(str(i) for i, (s, e) in zip(ids, where) if low <= s and e <= high)
            groups = ";".join(f"{inside(a, a_spans, low, high)}|{inside(b, b_spans, low, high)}" for low, high in zip([0, *cuts], cuts)) if len(a) < 400 else None
            links, j = [], 0
            for i, (s, e) in enumerate(a_spans):
                while b_spans[j][1] <= s:
                    j += 1
                k = j
                while k < len(b) and b_spans[k][0] < e:
                    links.append((a[i], b[k]))
                    k += 1
            count.update(links)
            rows.append((len(a), len(b), len(cuts), links, groups))
        highest = defaultdict(int)
        for (_, b), n in count.items():
            highest[b] = max(highest[b], n)
        sums = lambda links: (len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links))
        return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], *sums(r[3]), r[4] and hashlib.sha256(r[4].encode()).hexdigest()) for r in rows]

    return align


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def same(found, want):
    assert len(found) == len(want)
    for r, w in zip(found, want, strict=True):
        assert tuple(r[n] for n in NAMES[:-1]) == w[:-1] and w[-1] in (None, r["groups_sha256"])


def test_query(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    same(queries.op13_arrow_alignment(spark, sf_dir).orderBy("doc_id").collect(), plain([r["text"] for r in docs]))


@pytest.mark.parametrize(("stretch", "chunk"), [(1 << 20, 1 << 24), (40, 300)])
def test_odd_texts(spark, plain, monkeypatch, stretch, chunk):
    """Also in stretches of a few words and chunks of a few texts, and with a memory of a few words."""
    monkeypatch.setattr(alignment, "STRETCH", stretch)
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "REMEMBERED", stretch // 4)
    pair = alignment.Tokenizers(BYTES, PIECES)
    want = plain(ODD)
    rows = [b for b in alignment.chunks(enumerate(ODD), pair, 7)]
    assert [b["chunk"][0].as_py() for b in rows] == list(range(7, 7 + len(rows))) and (len(rows) > 1) == (chunk == 300)
    total, highest = Counter(), Counter()
    for b in rows:
        total.update(dict(zip(b["codes"][0].as_py(), b["times"][0].as_py())))
    for code, n in total.items():
        highest[code & 0xFFFFFFFF] = max(highest[code & 0xFFFFFFFF], n)
    found = []
    for b in rows:
        codes = b["codes"][0].as_py()
        answers = pa.table([range(len(codes)), [total[c] for c in codes], [total[c] == highest[c & 0xFFFFFFFF] for c in codes]], ["place", "count", "best"])
        found += alignment.answered(pa.Table.from_batches([b]), answers.take(list(range(len(codes)))[::-1])).to_pylist()
    assert [r["doc_id"] for r in found] == list(range(len(ODD)))
    same(found, want)
    assert [k for k, w in enumerate(want) if w[0] == 0][:2] == [0, 1] and sum(w[0] == 0 for w in want) < 8


def test_groups_are_written_as_stated():
    a, b = (pa.table([[2, 5, 9], [1, 2, 3]], ["key", "a"]), pa.table([[5, 7, 9], [4, 5, 6]], ["key", "b"]))
    links = alignment.overlaps(a, b)
    assert links.select(["a", "b"]).to_pylist() == [{"a": 1, "b": 4}, {"a": 2, "b": 4}, {"a": 3, "b": 5}, {"a": 3, "b": 6}]
    assert alignment.written_groups(links, 1, 10, 10).to_pylist() == ["1,2|4;3|5,6;"]


def test_edges(spark, plain):
    docs = spark.createDataFrame([(None if k == 4 else k, t, 1, 2, 3) for k, t in enumerate(ODD)], "doc_id long, text string, chunk int, links int, codes int")
    found = alignment.align(docs, BYTES, PIECES).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted("None" if k == 4 else str(k) for k in range(len(ODD)))
    by_id = {4 if r["doc_id"] is None else r["doc_id"]: r for r in found}
    same([by_id[k] for k in range(len(ODD))], plain(ODD))
    assert alignment.align(docs.limit(0), BYTES, PIECES).collect() == []
