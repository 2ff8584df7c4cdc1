"""Operators that treat each row by itself: token counts, PII, byte BPE, media columns."""

import hashlib
import re
import wave
import zlib
from functools import lru_cache
from io import BytesIO

import public_tokenizers
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.llm import byte_bpe as B, media as M, pii as P, token_counts as C

from .fixtures import ROWS, documents, sorted_rows

TEXTS = st.text(alphabet="ab  \n▁é☃.1'@<s>\x1c", max_size=80)


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_token_counts_equal_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=C.DEFAULT_MODEL)
    want = sorted(((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 50) for i, t, _ in ROWS), key=repr)
    assert sorted_rows(C.token_counts(documents(spark), limit=50, batch_bytes=2000, split_bytes=100)) == want
    assert C.token_counts(documents(spark).limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_cuts_are_safe(text):
    model = sentencepiece.SentencePieceProcessor(model_file=C.DEFAULT_MODEL)
    assert C._counts([text], C.DEFAULT_MODEL, 20, 5)[0] == len(model.encode(text))


def test_token_counts_of_other_libraries(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    found = dict(C.token_counts(documents(spark).where("doc_id < 6"), model=path).select("doc_id", "n_tokens").collect())
    assert found == {i: len(own.encode(t, add_special_tokens=False).ids) for i, t, _ in ROWS if i and i < 6}


@lru_cache(maxsize=1)
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.load_ranks(B.DEFAULT_RANKS), special_tokens={})


def test_byte_bpe_equals_the_library_and_decodes(spark):
    own = encoding()
    want = []
    for i, t, _ in ROWS:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")))
    assert sorted_rows(B.encoding_digests(documents(spark))) == sorted(want, key=repr)
    full = B.encode_documents(documents(spark), carry=["lang", "key"])
    assert sorted_rows(full.select("doc_id", F.size("token_ids"), F.sha2("decoded", 256))) == sorted(((i, n, d) for i, n, _, d in want), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | TEXTS)
def test_encode_text(text):
    assert B.encode_text(text) == encoding().encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=2, max_size=120))
def test_short_and_long_folds_agree(word):
    ranks = B._words(B.DEFAULT_RANKS).ranks
    kept, B.SHORT = B.SHORT, 1000
    try:
        short = B.fold(word, ranks)
    finally:
        B.SHORT = kept
    assert short == ([ranks[word]] if word in ranks else B._fold_long(word, ranks))


def test_words_by_higher_order_functions(spark):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258, b"cab": 259, b"aa": 260, b"aaaa": 261}
    words = ["", "a", "abc", "abcabc", "aaaaa", "bcab", "é", "zab"]
    found = B.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), "word", ranks).collect()
    assert {r.word: r.token_ids for r in found} == {w: B.fold(w.encode(), ranks) if w else [] for w in words}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="01234567895@.+-() a%x☃:/", max_size=60) | st.lists(st.sampled_from(["4111 1111 1111 1111", "a.b@c.de", "+1 (212) 555-0100", "10.0.0.1", "256.1.1.1", " ", "@", ".", "x", "1", "-", "+", "iban DE89370400440532013000"]), max_size=8).map("".join))
def test_base_spans_equal_the_patterns(text):
    found = P.find_spans(text)
    assert {k: found[k] for k in P.BASE} == base_spans(text)


def test_added_spans():
    text = "IBAN DE89 3704 0044 0532 0130 00, iban DE00 3704 0044 0532 0130 00; account no. 12-345678 at https://me:pw@host.org/x"
    found = P.find_spans(text)
    assert [text[a:b] for a, b in found["account"]] == ["DE89 3704 0044 0532 0130 00", "12-345678"]
    assert [text[a:b] for a, b in found["login"]] == ["me:pw@host.org"]


def test_personal_data_rows_and_masks(spark):
    text = "☃ mail a@b.co, b@c.de; call +1 212 555 0100 from 10.0.0.1 with 4111 1111 1111 1111."
    df = documents(spark, [*ROWS, (20, text, "en")])
    row = P.find_personal_data(df).where("doc_id = 20").first()
    want = ",".join(f"{k}:{a}:{b}" for k, v in base_spans(text).items() for a, b in v)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (2, 1, 1, 1) and row.base_sha256 == sha(want) and row.spans == want and row.n_spans == 5
    masked = P.redact(df)
    assert masked.columns == df.columns and masked.count() == df.count()
    assert masked.where("doc_id = 20").first().text == "☃ mail <EMAIL>, <EMAIL>; call <PHONE> from <IP> with <CARD>."
    assert masked.where("doc_id = 6").first().text is None and masked.where("doc_id = 9").first().text == dict((r[0], r[1]) for r in ROWS)[9]
    assert P.redact(df.limit(0)).collect() == []


def test_media_round_trip(spark):
    found = M.describe_media(M.store_text(documents(spark)), ["doc_id", "n_bytes"]).collect()
    texts = {i: t for i, t, _ in ROWS}
    assert len(found) == len(ROWS)
    for r in found:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_type) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]), "audio/wav")
    with wave.open(BytesIO(M.as_wav(M.padded(b"abc")))) as w:
        assert (w.getsampwidth(), w.getnchannels(), w.readframes(100)) == (1, 1, M.padded(b"abc"))


def png():
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing_corrects_types_and_carves(spark):
    import gzip

    image, packed = png(), gzip.compress(b"hello")
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x2c" + bytes(9) + b"\x02\x01\x00\x00" + b"\x3b"
    rows = [
        (1, image, "image/jpeg"), (2, b"text " + image + b" RIFF BM \xff\xd8\xff" + packed + gif, None), (3, image[:-4] + b"\0\0\0\0", "image/png"), (4, M.as_wav(M.padded(image)), "audio/wav"),
        (5, b"", None), (6, None, None), (7, b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02xx\xff\xd9", None), (8, gif, "image/gif"),
    ]
    df = spark.createDataFrame(rows, "id int, media binary, declared string")
    found = {r.id: r for r in M.describe_media(df, ["id"], declared_col="declared").collect()}
    assert found[1].media_type == "image/png" and found[1].retyped and not found[8].retyped
    assert found[2].embedded == [f"image/png:5:{len(image)}", f"application/gzip:{5 + len(image) + 12}:{len(packed)}", f"image/gif:{5 + len(image) + 12 + len(packed)}:{len(gif)}"]
    assert found[3].media_type == "application/octet-stream" and found[4].embedded == [f"image/png:44:{len(image)}"]
    assert found[5].media_bytes == found[6].media_bytes == 0 and found[7].media_type == "image/jpeg"


def test_sniffing_takes_time_in_proportion():
    import time

    for unit in (b"%PDF-", b"PK\x03\x04", b"%PDF-1 startxref ", b"\xff\xd8\xff\xda\x00\x02"):
        data = unit * ((2 << 20) // len(unit))
        began = time.perf_counter()
        M.sniff(data)
        assert time.perf_counter() - began < 10, unit


def test_stored_form_and_feature(spark):
    found = M.describe_media(M.store_text(documents(spark)).withColumn("declared", F.lit("text/plain")), ["doc_id"], declared_col="declared").collect()
    texts = {i: t for i, t, _ in ROWS}
    for r in found:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        out = BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(1), w.setframerate(M.RATE), w.writeframes(payload)
        media = out.getvalue()
        mean, power = sum(payload) / len(payload), sum((x - 128) ** 2 for x in payload) / len(payload)
        assert (r.media_bytes, r.media_sha256, r.retyped) == (len(media), sha(media), True)
        assert r.feature == f"audio/wav;n={len(payload)};mean={mean:.4f};power={power:.4f};embedded={len(r.embedded)}"


def test_words_by_higher_order_functions_with_all_ranks(spark):
    ranks = B.load_ranks(B.DEFAULT_RANKS)
    words = sorted({w for _, t, _ in ROWS for w in re.findall(r" ?\w+", t or "") if len(w) < 20})[:40] + [" straße", "🙂é", "internationalisation"]
    found = B.encode_words(spark.createDataFrame([(w,) for w in words], "word string").coalesce(1), "word", ranks).collect()
    assert {r.word: r.token_ids for r in found} == {w: B.fold(w.encode(), ranks) for w in words}
