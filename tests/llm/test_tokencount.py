import random

import pytest

from nearmark.llm import tokencount
from nearmark.llm.tokencount import Encoder, default_model, token_counts

pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_model())


def odd_texts():
    rng = random.Random(5)
    words = ["the", "naïve", "x", "…", "日本語", "  ", "\n", "\t", "</s>", "▁", "🙂🙂", "aaaa", "1234", "pre-fix", " ", "é"]
    return ["", " ", "a", *["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 400))) for _ in range(60)], "ab" * 3000, "日本" * 900, " " * 700]


def test_ends_are_offsets_of_the_tokens(encoder):
    for text in odd_texts():
        ends = encoder.ends(text)
        assert len(ends) == len(encoder.model.encode(text))
        assert not len(ends) or ends[-1] == len(text)


def test_proven_places_are_boundaries_of_any_chunk(encoder):
    for text in odd_texts():
        ends = set(encoder.ends(text).tolist())
        for at in range(1, len(text)):
            if encoder.proven(text, at):
                assert at in ends


@pytest.mark.parametrize(("chunk", "overlap"), [(2, 2), (7, 3), (50, 10), (64, 64)])
def test_chunks_give_the_librarys_counts(spark, documents, encoder, chunk, overlap):
    texts = [*odd_texts(), None]
    df = documents(list(enumerate(texts)), ["n_tokens", "_text", "_row"])
    got = {r[0]: r for r in token_counts(df, default_model(), chunk=chunk, overlap=overlap).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i]["n_tokens"] == len(encoder.model.encode(text or ""))
        assert got[i]["n_bytes"] == len((text or "").encode())


def test_null_and_repeated_keys_and_no_rows(spark, documents):
    df = documents([(None, "one two"), (None, "one two"), (4, "x " * 40)])
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_counts(df, default_model(), chunk=10, overlap=4).collect())
    assert got[0] == got[1] and len(got) == 3
    assert token_counts(df.where("false"), default_model()).count() == 0
    assert tokencount.OVERLAP_CHARS < tokencount.CHUNK_CHARS
