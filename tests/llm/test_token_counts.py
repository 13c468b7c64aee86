import random
from collections import Counter

import public_tokenizers as P
import pytest
from conftest import words
from tokenizers import Tokenizer

from longspan.llm import token_counts as tc

SPACES = ["", " ", "  ", "\n", "\t ", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", "​", "　", "\x00"]
ODD = ["'s", "'LL", "don't", "12", "½", "Ⅷ", "漢字", "é", "é", "ß", "İ", "_", "--", "😀", "👩‍💻", "ا", "<|endoftext|>", "<|endoftext", "|>", "<|ENDOFTEXT|>"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def got(df, **k):
    return Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in tc.token_counts(df, **k).collect())


def want(rows, library):
    ids = library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    return Counter((i, len((t or "").encode()), len(x.ids)) for (i, t), x in zip(rows, ids))


@pytest.mark.parametrize("chunk", [1, 500, tc.CHUNK])
def test_counts_are_the_librarys(make, library, lexicon, chunk):
    rng = random.Random(chunk)
    rows = [(k, "".join(rng.choice([words(rng, 1, lexicon), *ODD]) + rng.choice(SPACES) for _ in range(rng.randint(0, 40)))) for k in range(300)]
    assert got(make(rows), chunk_chars=chunk, bucket_chars=100) == want(rows, library)


def test_pieces_of_odd_strings(library):
    """Without Spark: many strings of odd characters, spaces and special strings."""
    rng, pieces = random.Random(3), tc.Pieces.of(tc.VOCABULARY)
    pool = [*ODD, *SPACES, *(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(3000))]
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 25)))
        found = pieces.frequencies(text)
        assert sum(n * pieces.count(x) for x, n in found.items()) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_each_distinct_pretoken_is_counted_once(monkeypatch):
    """A word that all texts hold comes once from each chunk, and its bucket counts it once."""
    rows = [(k, f"everywhere {k} everywhere") for k in range(400)]
    chunk = tc._Chunk(0)
    for k, text in rows:
        chunk.add((k, len(text)), tc.Pieces.of(tc.VOCABULARY).frequencies(text))
    table = tc.pa.Table.from_batches([tc._batch([r for r in chunk.packed(1) if r[1] == 0], tc.PACKED)])
    asked = Counter()
    monkeypatch.setattr(tc.Pieces, "count", lambda self, word: asked.update([word]) or 1)
    tc._count(tc.VOCABULARY)(tc.pa.concat_tables([table] * 3))
    assert asked["everywhere"] == 1 and max(asked.values()) == 1 and len(asked) == len(chunk.word)


def test_odd_rows(odd, none, library):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd) == want(rows, library)
    assert tc.token_counts(none).collect() == []
    assert tc.token_counts(none).columns == ["doc_id", "n_bytes", "n_tokens"]


def test_a_very_long_text(make, library, lexicon):
    rng = random.Random(4)
    rows = [(1, words(rng, 200_000, lexicon)), (2, "a" * 100_000), (3, "short")]
    assert got(make(rows), chunk_chars=1000) == want(rows, library)


def test_query_on_all_documents(spark, library):
    from longspan.llm.common import table

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    have = tc.op12_token_counts(spark, sf).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in have) == want(rows, library)
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in have)
