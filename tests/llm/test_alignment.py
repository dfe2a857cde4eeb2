"""Cross-tokenizer alignment against a plain version that compares all byte ranges."""

import random
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as E
import brute
from test_operators import SCHEMA, SF, awkward, given, got, pairs, tokenizer, wanted
from tabtaint.llm import alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
PATHS = ["byte_bpe_50k.json", "piece_bpe_32k.model"]


def token_bytes():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(tokenizer(PATHS[0]))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PATHS[1]))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in A's tokens
    char = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}

    def of_a(text):
        e = a.encode(text, add_special_tokens=False)
        return [(i, bytes(char[c] for c in a.id_to_token(i))) for i in e.ids]

    def of_b(text):
        ids = b.encode(text)
        names = map(b.id_to_piece, ids)
        return [(i, bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode()) for i, n in zip(ids, names)]

    return of_a, of_b


def ranges(tokens):
    out, end = [], 0
    for i, x in tokens:
        out.append((end, end := end + len(x), i))
    return out


def expected(rows):
    of_a, of_b = token_bytes()
    docs, count = [], Counter()
    for i, text in rows:
        a, b = (of_a(" " + text), of_b(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        a, b = ranges(a), ranges(b)
        links, k = [], 0
        for s, e, x in a:
            while k < len(b) and b[k][1] <= s:
                k += 1
            j = k
            while j < len(b) and b[j][0] < e:
                links.append((x, b[j][2]))
                j += 1
        shared = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        sides = []
        for tokens in (a, b):
            groups, at = [[] for _ in shared], 0
            for _, e, x in tokens:
                while shared[at] < e:
                    at += 1
                groups[at].append(str(x))
            sides.append(groups)
        text = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides))
        count.update(links)
        docs.append((i, len(a), len(b), len(shared), links, brute.sha(text) if a else ""))
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(i, n_a, n_b, g, len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), h)
            for i, n_a, n_b, g, ls, h in docs]


def paths():
    return map(tokenizer, PATHS)


def test_alignment_query(spark):
    assert got(E.queries()["op11_tokenizer_alignment"](spark, SF), *COLUMNS) == wanted(expected(given(spark)))


def odd_texts():
    r = random.Random(5)
    letters = "abcé漢🎉 .,'\n\t▁  <0x41></s>"
    return ["<s> x <0x41> </s> <|endoftext|>", "a▁b", "▁", " lead", "trail ", "a  b   c", "\n\n", " ", "ﬁ ① é é", "x\x00y z",
            "　 nb x   y", "\x1c a \x1d", "supercalifragilisticexpialidocious " * 30,
            *["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(200)]]


def test_alignment_odd_texts(spark):
    rows = list(enumerate(odd_texts()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert got(alignment.alignments(docs, *paths()), *COLUMNS) == wanted(expected(rows))


@pytest.mark.parametrize("chunk", [1, 16 << 20])
def test_alignment_awkward(spark, chunk, monkeypatch):
    """Also with a chunk for each batch, and a memory that is emptied after each."""
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(alignment, "WINDOWS_KEPT", 1 if chunk == 1 else 10**6)
    docs = spark.createDataFrame(awkward(), SCHEMA).repartition(3)
    assert got(alignment.alignments(docs, *paths()), *COLUMNS) == wanted(expected(pairs()))


def test_alignment_empty(spark):
    assert alignment.alignments(spark.createDataFrame([], SCHEMA), *paths()).count() == 0
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert got(alignment.alignments(docs, *paths()), *COLUMNS) == wanted([(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")])


def test_windows_of_equal_hash(monkeypatch):
    """Windows whose hashes collide are told apart by their ids."""
    import numpy as np
    t = alignment.Tokenizers(*paths())
    w = alignment.Windows(t)
    import pyarrow as pa
    a, n_a, b, n_b = t.ids(pa.array(["one two three two", "", "three, one"]))
    right = [w.text[k] for k in w.of(a, n_a, b, n_b)[0]]
    w.forget()
    monkeypatch.setattr(alignment, "mixed", lambda x, salt=0: np.zeros_like(x))
    assert [w.text[k] for k in w.of(a, n_a, b, n_b)[0]] == right
