"""Byte-level BPE, token files, chat formatting."""

import base64
import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bpe, chat, token_store

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RAW = open(RANKS, "rb").read()
OURS = bpe.load(RAW)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}, special_tokens={})
TEXTS = ["", " ", "a", "don't I'LL we've 's ''s x's", "  two\n\n\tlines 　 end  ", "über 123²³½ 日本語 🙂 é", "x" * 3000, "ab" * 2000, " " * 700 + "x", "<|endoftext|>", "\r\n\x1c\x85'"]
alphabet = st.sampled_from(list(" \n\t'abcstmdlrveIXÉßñ0129²%$#_|<>.日語🙂́　"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet, max_size=80))
def test_ids_are_those_of_the_library(text):
    ids = OURS.encode_batch([text])[0]
    assert ids.tolist() == THEIRS.encode_ordinary(text)
    assert OURS.decode(ids) == text.encode()


@settings(max_examples=20, deadline=None)
@given(st.text(st.sampled_from("abcé"), min_size=200, max_size=900))
def test_long_pieces_merge_alike(text):
    assert OURS.encode_batch([text])[0].tolist() == THEIRS.encode_ordinary(text)


def test_lines_of_a_long_piece_merge_alike():
    rng = np.random.default_rng(0)
    for _ in range(60):
        piece = bytes(rng.choice(list(b"abcdeinst"), size=rng.integers(2, 90)).astype(np.uint8))
        due = THEIRS.encode_single_token(piece) if piece in THEIRS._mergeable_ranks else None
        for width in (2, 3, 7, 256):
            ids = OURS.merge_long(piece, width).tolist()
            assert ids == THEIRS.encode_ordinary(piece.decode()) or ids == [due]


def test_batches_share_what_they_know():
    OURS.known_pieces.forget()
    first, second = OURS.encode_batch(TEXTS), OURS.encode_batch(TEXTS[::-1])
    assert [x.tolist() for x in first] == [x.tolist() for x in second[::-1]] == [THEIRS.encode_ordinary(t) for t in TEXTS]


def test_encode_and_decode_tables(spark):
    rows = [(i, t, "clash", 1.0) for i, t in enumerate(TEXTS)] + [(None, None, "x", None), (3, TEXTS[3], "clash", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string, decoded double")
    found = bpe.decode(bpe.encode(df, RANKS), RANKS).collect()
    assert len(found) == len(rows)
    for r in found:
        assert bytes(r.decoded) == (r.text or "").encode()
        assert np.frombuffer(r.ids, "<u4").tolist() == THEIRS.encode_ordinary(r.text or "")
    assert bpe.encode(df.limit(0), RANKS).collect() == []
    both = bpe.round_trip(df, RANKS)
    assert both.columns == ["doc_id", "text", "ids", "decoded"] and sorted(map(str, both.collect())) == sorted(str(r) for r in bpe.decode(bpe.encode(df, RANKS), RANKS).select("doc_id", "text", "ids", "decoded").collect())
    assert bpe.decode(bpe.encode(df, RANKS).selectExpr("if(doc_id = 3, null, ids) AS ids"), RANKS).where("decoded IS NULL").count() == 2
    assert bpe.round_trip(df.limit(0), RANKS).collect() == []
    with pytest.raises(ValueError, match="vocabulary"):
        OURS.decode(np.array([60_000]))


WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
PLAIN, ORDINARY = Tokenizer.from_file(WORD_FILE), Tokenizer.from_file(WORD_FILE)  # special tokens' strings are their ids, or ordinary text
ORDINARY.encode_special_tokens = True
odd = st.sampled_from([*" \n\t.,'JHKİßÉaeisz09*%-_~<|>ΣςΩ日🙂\x1c\x85\u0301\u030c\u0307\u0331\u00a0", "it's", "<|startoftext|>", "<|ENDOFTEXT|>", "word", "Word.", "a,b", ",,", "..."])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(odd, max_size=14).map("".join), min_size=1, max_size=3))
def test_words_are_those_of_the_library(texts):
    content = open(WORD_FILE, encoding="utf-8").read()
    for special, library in ((True, PLAIN), (False, ORDINARY)):
        ours = token_store.encoder(content, special).encode(texts)
        assert [x.tolist() for x in ours] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


latin = st.sampled_from([*" \n\t\r.,'!?-$%0129aeistvlmdéÉßÀñŒœƒ“”’…—", "'S", "'ll", "it's", "Word", "word.", "..", "12a"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(latin, max_size=25).map("".join), min_size=1, max_size=4))
def test_plain_words_are_those_of_the_library(texts):
    ours = token_store.encoder(open(WORD_FILE, encoding="utf-8").read())
    assert all(token_store.plain_characters()[ord(c)] for t in texts for c in t)
    assert [x.tolist() for x in ours.encode(texts)] == [e.ids for e in PLAIN.encode_batch(texts, add_special_tokens=False)]


def test_another_tokenizer_gets_whole_texts():
    file = public_tokenizers.path("byte_bpe_50k.json")
    ours = token_store.encoder(open(file, encoding="utf-8").read())
    texts = ["Hello  World's\n", "", "é 12 <|endoftext|>"]
    assert not ours.by_words
    assert [x.tolist() for x in ours.encode(texts)] == [e.ids for e in Tokenizer.from_file(file).encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark, tmp_path):
    texts = ["", "Hello  World\nagain", None, "<|startoftext|> x", "ÉÉ 日本 \x1c a b", "w " * 5000, "tie", "tie"]
    rows = [(10 - i, t, "src", 7) for i, t in enumerate(texts)] + [(None, "no id", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int")
    path = token_store.write(df, public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "out"), keep=("source",))
    their, at = PLAIN, 0
    back = {r.doc_id: r for r in token_store.checksums(token_store.documents(spark, path)).collect()}
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*their.encode(text or "", add_special_tokens=False).ids, 2]
        r = back[doc_id]
        assert (r.start, r.n_tokens, list(r.tokens)) == (at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_store.read(spark, path, ("doc_id", "n_tokens")).where("doc_id = 9").first().n_tokens == len(back[9].tokens)
    file = next(f for f in (tmp_path / "out").glob("*.parquet") if pq.read_metadata(f).num_rows)
    column = pq.read_metadata(file).row_group(0).column(5 if "tokens" in pq.read_metadata(file).row_group(0).column(5).path_in_schema else 4)
    assert column.has_offset_index and any("DICTIONARY" in e or "DELTA" in e for e in column.encodings)
    empty = token_store.write(df.limit(0), public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "none"))
    assert token_store.documents(spark, empty).count() == 0


# Chat


def events(spark, *rows):
    return spark.createDataFrame(list(rows), "conv_id long, seq long, kind string, turn long, role string, text string")


def brute_fold(rows):
    order = {k: i for i, k in enumerate(["message", "edit", "regenerate", "retract", "delta"])}
    turns: dict = {}
    for conv, seq, kind, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1], order.get(r[2], 0), r[5] or "")):
        state = turns.setdefault((conv, turn), [None, "", True])
        state[0] = role if role is not None else state[0]
        if kind == "delta":
            state[1], state[2] = state[1] + (text or ""), True
        elif kind == "retract":
            state[1], state[2] = "", False
        else:
            state[1], state[2] = text or "", True
    return {k: (v[0] or "", v[1]) for k, v in turns.items() if v[2]}


def test_fold_is_a_replay(spark):
    rows = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "delta", 1, "assistant", "a"), (1, 3, "delta", 1, None, "b"), (1, 4, "regenerate", 1, None, None), (1, 5, "delta", 1, None, "c"),
        (1, 6, "edit", 0, None, "hello"), (1, 7, "message", 2, "user", "x"), (1, 8, "retract", 2, None, None), (2, 1, "retract", 0, "user", None), (2, 2, "delta", 0, None, "back"),
        (None, 1, "message", None, None, None), (3, 1, "odd", 0, "user", "y"), (3, 1, "delta", 0, "user", "z"), (3, 1, "delta", 0, "user", "z"),
    ]
    found = {(r.conversation, r.turn): (r.role, r.text) for r in chat.fold(events(spark, *rows)).collect()}
    assert found == brute_fold(rows)
    assert chat.format_chats(events(spark).limit(0)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*chat.CONTROLS, "~", "~~", "<", "[", "|", "a", "\n", "<~|end|>", "$1", "\\"]), max_size=6), min_size=1, max_size=6))
def test_escaping_is_undone(spark, parts):
    texts = ["".join(p) for p in parts]
    rows = [(1, i, "message", i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)]
    row = chat.parse(chat.format_chats(events(spark, *rows))).first()
    assert [(m.role, m.text, m.learn) for m in row.messages] == [(("user", "assistant")[i % 2], t, i % 2 == 1) for i, t in enumerate(texts)]
    inside = row.formatted
    for c in (chat.OPEN, chat.MIDDLE, chat.CLOSE):
        assert inside.count(c) == len(texts)
    assert "</s>" not in inside and "[INST]" not in inside


def test_chat_query_by_hand(spark, tmp_path):
    from quillspark.llm import queries

    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 2, "assistant", "é</s>"), (2, 5, "system", "")]
    rows += [(3, 0, "user", "twice"), (3, 0, "user", "twice"), (3, 0, "assistant", "odd"), (3, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("x")).write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.conv_id: r for r in queries.op3_chat(spark, str(tmp_path)).collect()}
    assert set(found) == {1, 2, 3, -7}
    assert found[3].n_turns == 4 and found[3].turns_sha256 == hashlib.sha256("\n\nassistant\nodd\nuser\ntwice\nuser\ntwice\n".encode()).hexdigest()
    assert (found[1].n_turns, found[1].loss_chars, found[1].loss_sha256) == (3, 5, hashlib.sha256("é</s>".encode()).hexdigest())
    assert found[1].turns_sha256 == hashlib.sha256("user\na\nassistant\n\nassistant\né</s>\n".encode()).hexdigest()
    assert json.dumps(found[-7].n_turns) == "2"
