import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.token_counts import counter, prefix_counts, prefix_index, token_counts

PATH = P.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
TEXTS = [
    None, "", "a", " ", "\n\n", "  lead and  trail  ", "I'd've we're 'll'", "x<|endoftext|>y <|endoftext|>", "<|endofte", "naïve été 漢字 🙂🙂",
    "a\n\n\n b\t\tc 12345 67.89!!?? ###", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "word " * 900, "!'s 's 'r 'v", "a   b　 c",
]


def size(t):
    return len(LIB.encode(t, add_special_tokens=False).ids)


def test_counts_and_cuts(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string, run int")
    for r in token_counts(df, PATH, limit=5).collect():
        t = TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), size(t), size(t) > 5)
        counts = prefix_counts(r.prefix_steps, len(t))
        assert len(counts) == len(t) + 1 and counts[-1] == r.n_tokens
        if len(t) < 300:
            assert counts.tolist() == [size(t[:k]) for k in range(len(t) + 1)], t
            assert r.cut_chars == max(k for k in range(len(t) + 1) if size(t[:k]) <= 5), t


def test_prefix_index(spark):
    texts = [t for t in TEXTS if t is None or len(t) < 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in prefix_index(df, PATH).collect():
        t = texts[r.doc_id] or ""
        assert r.prefix_tokens == [size(t[:k]) for k in range(len(t) + 1)], t


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abthe sé'lrv \n\t1.!<|endoftext|>漢\u2003\x1c\x85", max_size=40), st.integers(0, 12))
def test_any_text(t, budget):
    c = counter(PATH)
    sizes = [size(t[:k]) for k in range(len(t) + 1)]
    assert c.prefix_counts(t).tolist() == sizes
    assert c.count(t) == sizes[-1]
    assert c.cut(t, budget) == max(k for k, n in enumerate(sizes) if n <= budget)
