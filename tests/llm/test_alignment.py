"""Alignment of two tokenizers against plain loops over token bytes."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from evidentia.llm import alignment as A

from .fixtures import documents, prose


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = A.byte_letters()
    found = []
    for i, text in rows:
        toks_a = [(t.id, bytes(letters[c] for c in t.value)) for t in map(lambda x: Token(a, x), a.encode(" " + text, add_special_tokens=False).ids)] if text else []
        toks_b = [(t, bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode()) for t in b.encode(text)] if text else []
        whole = (" " + text).encode() if text else b""
        if not b"".join(x for _, x in toks_a) == b"".join(x for _, x in toks_b) == whole:
            toks_a = toks_b = []
        spans = []
        for toks in (toks_a, toks_b):
            at, own = 0, []
            for t, x in toks:
                own.append((t, at, at + len(x)))
                at += len(x)
            spans.append(own)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        links = [(x, y) for x, s, e in spans[0] for y, u, v in spans[1] if s < v and u < e]
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(t) for t, s, e in own if low <= s and e <= cut) for own in spans))
            low = cut
        found.append((i, spans, cuts, links, ";".join(groups)))
    counts = Counter(p for *_, links, _ in found for p in links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for i, spans, cuts, links, text in found:
        out.append((i, len(spans[0]), len(spans[1]), len(cuts), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if links else ""))
    return sorted(out, key=repr)


class Token:
    def __init__(self, tokenizer, number):
        self.id, self.value = number, tokenizer.id_to_token(number)


TEXTS = [
    prose(1, 80), prose(1, 80), prose(2, 30), None, "", " ", "  two  spaces \n\n and\ttabs ", "Ünïcödé ☃ 𝒳   \x1c end", "holds ▁ the mark", "<|endoftext|> and </s> <s> <unk> <0x41>", "日本語のテキスト, русский текст", "x" * 3000, "don't we'll I'd 12345 $%&!!  \u0085",
    "​­ é ﬁ", "a", "\x00\x01",
]


@pytest.mark.parametrize("size", [1 << 20, 200])
def test_alignment_matches_plain_loops(spark, size):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, prose(5, 60)), (None, prose(1, 80))]
    df = documents(spark, [(i, t, "en") for i, t in rows]).repartition(3)
    found = A.alignments(df, block_bytes=size)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(rows)
    groups = A.alignments(df, digests=False, block_bytes=size).select("doc_id", "groups").collect()
    assert sorted(hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "" for r in groups) == sorted(r[-1] for r in plain(rows))


def test_cut_texts_give_the_same_tokens(spark, monkeypatch):
    text = " ".join(["Some words, «quoted» and 12 numbers; don't  cut\n here. ☃☃ ok"] * 30)
    rows = [(1, text), (2, prose(3, 400))]
    want = [A.Aligned([t for _, t in rows], A.MODEL_A, A.MODEL_B).texts]
    monkeypatch.setattr(A, "PART", 40)
    assert [A.Aligned([t for _, t in rows], A.MODEL_A, A.MODEL_B).texts] == want


def test_ranks_give_the_file_s_ids_for_every_latin_character():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(A.MODEL_A)
    own.encode_special_tokens = True
    ranked = A._by_ranks(A.MODEL_A)
    texts = [form.replace("?", chr(c)) for c in range(256) for form in (" a?b", " ?", "? ?1", " ?? ?'s", "x ?  ?\n?")] + [" <|endoftext|>"]
    assert [ranked.encode_ordinary(t) for t in texts] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_empty_table_and_texts_without_tokens(spark):
    assert A.alignments(documents(spark).limit(0)).collect() == []
    found = A.alignments(documents(spark, [(1, None, "en"), (1, "", None), (2, "▁", "x")])).collect()
    assert sorted(tuple(r) for r in found) == [(1, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
