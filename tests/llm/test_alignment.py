"""Alignment of two tokenizers against all pairs of tokens."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from quotecurve.llm import alignment
from quotecurve.llm.bpe import byte_letters


def _coded(text, a, b, letters):
    if not text:
        return [], [], [], []
    whole = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(k)) for k in ids_a]
    bytes_b = []
    for k in ids_b:
        piece = b.id_to_piece(k)
        bytes_b.append(bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") else piece.replace("▁", " ").encode())
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return [], [], [], []
    return ids_a, ids_b, np.cumsum([*map(len, bytes_a)]).tolist(), np.cumsum([*map(len, bytes_b)]).tolist()


def _wanted(texts):
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path(alignment.A_FILE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B_FILE))
    letters = {letter: k for k, letter in enumerate(byte_letters())}
    rows, held = [], Counter()
    for text in texts:
        ids_a, ids_b, end_a, end_b = _coded(text, a, b, letters)
        links = []
        for i, stop_a in enumerate(end_a):
            start_a = end_a[i - 1] if i else 0
            for j, stop_b in enumerate(end_b):
                start_b = end_b[j - 1] if j else 0
                if start_a < stop_b and start_b < stop_a:
                    links.append((ids_a[i], ids_b[j]))
        groups, i, j = [], 0, 0
        for cut in sorted(set(end_a) & set(end_b)):
            to_a, to_b = end_a.index(cut) + 1, end_b.index(cut) + 1
            groups.append(",".join(map(str, ids_a[i:to_a])) + "|" + ",".join(map(str, ids_b[j:to_b])))
            i, j = to_a, to_b
        rows.append((len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
        held.update(set(links))
    most = Counter()
    for (first, _), n in held.items():
        most[first] = max(most[first], n)
    return [
        (n_a, n_b, n, len(links), sum(held[k] == most[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if n_a else "")
        for n_a, n_b, n, links, text in rows
    ]


def _texts(messy):
    texts = [r["text"] for r in messy.select("text").collect()]
    texts += ["<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b", "two  spaces   here", " leading", "trailing ", "\ttab\r\nline", "naïve café 中文 🙂🙂", " nbsp", "ﬁ ligature ½", "é"]
    return [t for t in texts if t is None or len(t) < 3000] + ["x" * 600, "ab " * 400, " " * 50]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_of_every_pair(spark, messy, small, monkeypatch):
    if small:
        monkeypatch.setattr(alignment, "CHUNK_BYTES", 300)
        monkeypatch.setattr(alignment, "WORK", 7)
    texts = _texts(messy)
    frame = spark.createDataFrame(
        [(k if k % 7 else None, t, 1, 2, "x", 3, 4) for k, t in enumerate(texts)], "doc_id long, text string, row long, chunk long, pair string, id int, at int"
    )
    got = sorted((tuple(r) for r in alignment.aligned(frame).collect()), key=str)
    want = sorted(((k if k % 7 else None, *w) for k, w in enumerate(_wanted(texts))), key=str)
    assert got == want
    assert alignment.aligned(frame.limit(0)).count() == 0


def test_groups_are_real_outputs(spark):
    got = alignment.groups(spark.createDataFrame([(1, "naïve café"), (2, None)], "doc_id long, text string")).orderBy("id").collect()
    assert got[0]["groups"].count("|") >= 1 and got[1]["groups"] == "" and got[1]["links"] == []
    assert hashlib.sha256(got[0]["groups"].encode()).hexdigest() == _wanted(["naïve café"])[0][-1]


@pytest.mark.parametrize("work", [1, 2, 3, 10, 1000])
def test_pieces_of_a_merge_path(work):
    rng = np.random.default_rng(work)
    for _ in range(40):
        end = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, end + 1, rng.integers(1, 40)), end)) for _ in range(2))
        marks = alignment.diagonals(a, b, work)
        assert (np.diff(marks.sum(axis=1)) <= work).all() and tuple(marks[-1]) == (len(a), len(b))
        whole = np.concatenate([np.stack([a, 0 * a]), np.stack([b, 0 * b + 1])], axis=1)
        whole = whole[:, np.lexsort((whole[1], whole[0]))]
        for i, j in marks:
            assert sorted(map(tuple, whole[:, : i + j].T.tolist())) == sorted([(x, 0) for x in a[:i].tolist()] + [(x, 1) for x in b[:j].tolist()])
        ends = np.union1d(a, b)
        link_a, link_b, cut_a, cut_b = alignment.overlaps(a, b, work)
        assert link_a.tolist() == np.searchsorted(a, ends).tolist() and link_b.tolist() == np.searchsorted(b, ends).tolist()
        common = np.intersect1d(a, b)
        assert a[cut_a - 1].tolist() == common.tolist() and b[cut_b - 1].tolist() == common.tolist()
