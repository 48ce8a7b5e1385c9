"""The operators against brute force, the public tokenizer, exact round trips and held-out accuracy."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import DATA
from corpuskeel.llm import bpe, html, html_training, knn, near, shingles, tokencounts, toxicity

TABLES = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_spec(bpe.word_bpe()))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.word_bpe())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbtheing'sdlm 19½é́ΣσßЖ日🙂.,!<|>\n \x1c"), max_size=60))
def test_bpe_equals_the_library(encoder, library, text):
    text = text.replace("<<", "<|endoftext|>")
    own = encoder.encode([text])[0]
    ref = library.encode(text, add_special_tokens=False).ids
    assert own == ref
    assert encoder.decode(own) == library.decode(ref, skip_special_tokens=False)


def test_bpe_long_words(encoder, library):
    texts = ["a" * 4001, "ab" * 3000, "".join(random.Random(3).choice("thein") for _ in range(20000))]
    assert encoder.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@TABLES
def test_token_counts_across_blocks(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    folder, manifest = tokencounts.write_token_files(docs, bpe.word_bpe(), 49407)
    direct = {r.doc_id: r.n_tokens for r in bpe.encode_texts(docs, bpe.word_bpe(), special_tokens=False).collect()}
    for block in (7, 1000, 1 << 20):
        counts = tokencounts.count_tokens(folder, manifest.select("file"), 49407, block)
        assert {r.doc_id: r.n_tokens for r in manifest.join(counts, ["file", "ordinal"]).collect()} == direct


def reference_components(texts):
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in texts.items()}
    low = {i: i for i in texts}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_near_chain_and_crowd(spark):
    """A chain whose ends are not similar, copies, and a crowd that shares half of its words."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = {}
    for i in range(30):
        words = base[:]
        for k in range(i * 3):
            words[k] = f"c{i // 6}x{k}"
        texts[100 - i] = " ".join(words)
    for i in range(60):
        texts[200 + i] = " ".join(base[:60] + [f"u{i}n{k}" for k in range(60)])
    texts[300] = texts[100].upper()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near.near_duplicates(df).collect()}
    assert got == reference_components(texts)


def test_pigeonhole_covers_the_distance():
    """Signatures at the full distance share a key, wherever the errors lie, and are compared once."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        one = rng.integers(0, 1 << 16, near.SYMBOLS).astype(np.uint16)
        two = one.copy()
        at = rng.choice(near.SYMBOLS, near.DISTANCE, replace=False)
        two[at] ^= np.uint16(1)
        pair = np.stack([one, two])
        hits = 0
        for number in range(near.SYMBOLS):
            found = near.open_pairs(number, pair, np.array([0, 1]), np.zeros(2, bool), np.zeros(2, int), 0, 0)
            hits += found.shape[1]
        assert hits == 1


def test_word_hashes_split_at_ascii_space_only():
    same = shingles.word_hashes("Alpha\tbeta\x0bGAMMA  delta")
    assert len(same) == 4 and (same == shingles.word_hashes("alpha beta gamma delta")).all()
    assert len(shingles.word_hashes("a b c\x1cd")) == 1
    assert (shingles.word_hashes("É") != shingles.word_hashes("é")).all()


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(0, 0.2, (400, 12))
    vectors[50:180] = vectors[50]  # one vector that a third of all rows share
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in knn.top_k(df, df.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = np.floor(64 * vectors).astype(int)
    for i in range(0, 400, 20):
        score = q @ q[i]
        best = sorted((-int(s), j) for j, s in enumerate(score) if j != i)[:20]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]


def test_html_blocks_and_tree():
    tree = html.trained_tree()
    for page, texts in html_training.labelled_pages():
        assert {x for x in html.main_text(page, tree).split("\n") if x} == texts
    page = '<nav><a href=/>x</a></nav><article><p>A &amp; B&nbsp;&#233; <!-- <p>no --> c<br>d<script>"</p>"</script><p>Two < three</article><footer>f'
    assert html.main_text(page, tree) == "A & B é c d\nTwo < three"
    assert html.main_text("<" * 5000 + "p", tree) is not None


@TABLES
def test_toxicity_on_held_out_rows(spark):
    folder = DATA.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    right = [r.predicted == r.toxic for r in scored]
    # About 400 toxic rows to learn from; with the thousands of the larger tables both are near 1.
    assert np.mean(right) >= 0.97 and np.mean([r.predicted for r in scored if r.toxic]) >= 0.9


def test_toxicity_gradients_against_differences():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in toxicity.init(2).items()}
    words = [f"word{i}" for i in range(9)]
    x = toxicity.inputs(p, *toxicity.word_rows(words)).astype(np.float64) + rng.normal(0, 0.3, (9, 2 * toxicity.WIDTH))
    place = rng.integers(0, 9, (toxicity.WINDOW, 5))
    mask = (np.arange(toxicity.WINDOW)[:, None] < np.array([32, 7, 1, 20, 32])).astype(np.float64)
    y = np.array([1.0, 0, 1, 0, 1])

    def loss():
        logit, _ = toxicity.forward(p, toxicity.gates(p, x)[place], mask)
        return float(np.mean(np.logaddexp(0, logit) - y * logit))

    grad, dx = toxicity.gradients(p, x, place, mask, y)
    grad["x"] = dx
    for name, g in grad.items():
        table = x if name == "x" else p[name]
        for at in rng.integers(0, table.size, 4):
            kept = table.flat[at]
            table.flat[at] = kept + 1e-2
            up = loss()
            table.flat[at] = kept - 1e-2
            down = loss()
            table.flat[at] = kept
            assert abs((up - down) / 2e-2 - np.asarray(g).flat[at]) < 2e-3, name


def test_toxicity_learns_from_long_documents_only(spark):
    """Toxic documents of thousands of words, none short: they are learnt from and told apart."""
    rng = random.Random(2)
    plain = [f"calm{i}" for i in range(300)]
    docs = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(1500 if i % 2 else 60)]
        if i % 2:
            for k in rng.sample(range(1500), 150):
                words[k] = rng.choice(["rotten", "idiot", "scum"])
        docs.append((i, " ".join(words), i % 2))
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    scored = toxicity.score(df, toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))).join(df, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in scored]) >= 0.95
    one = df.filter("toxic = 1")
    assert {r.predicted for r in toxicity.score(df, toxicity.fit(one, one)).collect()} == {1}
    none = df.filter("toxic = 0")
    assert {r.predicted for r in toxicity.score(df, toxicity.fit(none, none)).collect()} == {0}
