from hypothesis import given, settings
from hypothesis import strategies as st

from sessionlake.llm.tokens import Decoder, Encoder, decode_corpus, default_tokenizer, encode_corpus, token_counts

ENCODER, DECODER = Encoder(default_tokenizer()), Decoder(default_tokenizer())
PIECES = st.sampled_from([" ", "  ", "\n", "\t", "a", "word", "é", "日本", "<|endoftext|>", "12", "!", "\x1c", "\x85", " ", "　", "​", "👍🏽", "'s", "B", "\r\n"])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(PIECES, max_size=30).map("".join)))
def test_parts_encode_as_the_whole(text):
    whole = ENCODER.tokenizer.encode(text, add_special_tokens=False).ids
    assert ENCODER.ids([text]) == [whole] and ENCODER.counts([text]) == [len(whole)]
    assert DECODER.text(whole) == text.encode("utf-8", "replace").decode("utf-8", "replace")


def test_offsets_name_characters():
    text = "naïve 日本 👍🏽 end"
    spans = ENCODER.offsets(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a <= b for a, b in spans)


def test_split_characters_decode():
    ids = ENCODER.ids(["👍"])[0]
    assert len(ids) > 1 and DECODER.text(ids) == "👍" and DECODER.text(ids[:1]) == "�" and DECODER.text([10**6]) == DECODER.text(None) == ""


SCHEMA = "doc_id long, text string, ids string, _text string"


def test_rows(spark):
    rows = [(1, None, "x", "y"), (2, "", None, None), (3, "hello world", None, None), (3, "hello world", None, None), (None, " a", None, None), (4, "long text " * 30_000, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = encode_corpus(df, "doc_id", "text", default_tokenizer()).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in got)[:5] == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2)]
    back = {r["doc_id"]: r["text"] for r in decode_corpus(encode_corpus(df, "doc_id", "text", default_tokenizer()), "doc_id", "ids", default_tokenizer()).collect()}
    assert back[1] == back[2] == "" and back[4] == rows[-1][1]
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts(df, "doc_id", "text", default_tokenizer()).collect()}
    assert counts[1] == counts[2] == 0 and counts[3] == 2
    offsets = {r["doc_id"]: (r["starts"], r["ends"]) for r in encode_corpus(df, "doc_id", "text", default_tokenizer(), with_offsets=True).collect()}
    assert offsets[3] == ([0, 5], [5, 11]) and offsets[1] == ([], [])
    assert encode_corpus(df.limit(0), "doc_id", "text", default_tokenizer()).count() == 0
