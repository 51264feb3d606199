import hashlib
import math
import random
import re
import string
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.secret_scan import CharClass, EntropyRules, Scanner, find_secrets, redact_secrets, secret_digest

TEXTS = [
    None, "", 'é token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and PASSWORD:short', "api_key=abcdefgh apikey='x' AKIAIOSFODNN7EXAMPL AKIAX",
    "f" * 32 + " " + "0" * 31 + " " + "F" * 40, "key Zx9Kq2mVb7Lw4Tn8Yc3Rf6Hj1Ds5Gp end", "3f2504e0-4f89-11d3-9a0c-0305e82c3301", "tokenſ=12345678 toKen=12345678",
    "Donaudampfschifffahrtsgesellschaftskapitaen " * 50,
]


def brute(t):
    t = t or ""
    out = []
    for k, (name, p, g, n) in enumerate(
        [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]
    ):
        out += [(m.start(), k, name, m.end()) for m in re.finditer(p, t, re.A) if len(m[g]) >= n]
    return [f"{n}:{a}:{b}" for a, _, n, b in sorted(out)]


def test_digest(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in secret_digest(df).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = brute(t)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(filter(None, rows[i].spans.split(",")))
    assert "entropy:4:34" in rows[5].spans and rows[6].spans == "" and rows[8].spans == ""


def test_redaction(spark):
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_chars long")
    rows = {r.doc_id: r for r in redact_secrets(df).collect()}
    assert rows[0].text is None and rows[0].n_chars == -1 and rows[8].text == TEXTS[8]
    assert rows[2].text == 'é [secret]" and PASSWORD:short' and rows[2].n_chars == len(rows[2].text)
    assert all(not brute(r.text) for r in rows.values())
    assert find_secrets(df.limit(0)).count() == 0


def entropy_spans(text, rules):
    """Brute force: each window of each run judged by itself, then joined; what a fixed pattern covers is left out."""
    marked = set()
    for c in rules.classes:
        for m in re.finditer(f"[{c.letters}]+", text):
            if any(re.fullmatch(a, m[0]) for a in rules.allow) or m[0] in rules.literals or len(m[0]) < c.window:
                continue
            gone = set()  # places of tokens that hold a placeholder
            for t in re.finditer("[^/_=-]+", m[0]):
                if any(p in t[0].lower() for p in rules.placeholders):
                    gone |= set(range(t.start(), t.end()))
            for i in range(len(m[0]) - c.window + 1):
                w = m[0][i : i + c.window]
                h = -sum(n / c.window * math.log2(n / c.window) for n in Counter(w).values())
                mixed = sum(any(f(x) for x in w) for f in (str.islower, str.isupper, str.isdigit))
                if h >= c.bits - 1e-9 and mixed >= c.mixed and sum(map(str.isdigit, w)) >= c.digits and not gone & set(range(i, i + c.window)):
                    marked.add((m.start() + i, m.start() + i + c.window))
    out = []
    for a, b in sorted(marked):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    base = [tuple(map(int, x.split(":")[1:])) for x in brute(text)]
    return [(a, b) for a, b in out if not any(s <= a and b <= e for s, e in base)]


TIGHT = EntropyRules(
    classes=(CharClass("low", "a-d0-3", 6, 1.7, 1), CharClass("mixed", "A-Da-d0-3/_=.\\-", 9, 2.15, 2, 1)), allow=("[0-3]+", "[a-d]+(?:/[a-d]+)+"), placeholders=("abc", "00"), literals=frozenset({"a1b2c3"})
)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="abcdABCD0123/_=-. ", max_size=70))
def test_entropy_spans_equal_brute_force(text):
    """With rules whose windows are short and whose letters aren't the usual ones: equal spans, neither more nor fewer."""
    got = [(a, b) for a, k, b in Scanner(TIGHT).scan(text)[1] if k == 3]
    assert got == entropy_spans(text, TIGHT)


def test_entropy_spans_of_strings_equal_brute_force():
    rng = random.Random(7)
    pools = [string.ascii_letters + string.digits, string.digits + "abcdef", "abcd0123", string.ascii_lowercase + "/-_", string.ascii_uppercase + "234567", "ab1/="]
    seen = 0
    for _ in range(3000):
        t = " ".join("".join(rng.choices(rng.choice(pools), k=rng.randint(10, 60))) + rng.choice(["", "/example/", "=xxxxxx", " password=12345678Abcdefgh"]) for _ in range(4))
        got = found(t)
        assert got == entropy_spans(t, EntropyRules()), t
        seen += len(got)
    assert seen > 1000
    run = "ab01" * 30_000 + "Zx9Kq2mVb7Lw4Tn8Yc3Rf6Hj1Ds5Gp"
    assert found(run) == [(a, b) for a, b in found(run) if b == len(run)] and len(found(run)) == 1


def found(t):
    return [(a, b) for a, k, b in Scanner(EntropyRules()).scan(t)[1] if k == 3]


def test_kinds_of_random_strings_are_found():
    rng = random.Random(2)
    for letters in (string.ascii_lowercase + string.digits, string.ascii_uppercase + "234567", string.ascii_letters + string.digits):
        for n, least in ((20, 0.9), (24, 0.95), (32, 0.98), (40, 0.99)):
            texts = [f"key {''.join(rng.choices(letters, k=n))} end" for _ in range(1000)]
            assert sum(bool(found(t)) for t in texts) >= least * len(texts), (letters, n)
    plain = "internationalizationservice2 thequickbrownfoxjumpsover THEQUICKBROWNFOXJUMPSOVER getUserAccountSettingsByNameAndRole"
    assert found(plain) == []


def test_a_placeholder_leaves_the_rest_of_its_run():
    secret = "Zx9Kq2mVb7Lw4Tn8Yc3Rf6Hj1Ds5Gp"
    for t in (f"/example/{secret}", f"{secret}/example", f"/example/{secret}/placeholder", f"changeme={secret}"):
        at = t.index(secret)
        assert [a <= at + 1 and b >= at + len(secret) - 1 for a, b in found(t)] == [True], t
    assert found("example" + secret) == [] and found(f"a/{secret}xxxxxx/b") == []
