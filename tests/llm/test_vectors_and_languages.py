"""Hard negatives, whitening and language identification: odd rows, and plain Python as the measure."""

import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from logstream.llm import bidiagonal, hard_negatives, language, queries, whitening
from logstream.llm.vectors import scaled, usable

NAN, INF = float("nan"), float("inf")


class TestUsable:
    def test_only_whole_finite_vectors(self, spark):
        vectors = [None, [], [1.0], [1.0, None], [NAN], [INF], [-INF, 1.0], [0.49, -0.01]]
        frame = spark.createDataFrame(list(enumerate(vectors)), "i int, e array<float>")
        kept = frame.filter(usable("e")).select("i", scaled("e", 100, 5).alias("x")).collect()
        assert {r.i: r.x for r in kept} == {1: [], 2: [105], 7: [54, 4]}


def plain_negatives(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    """All rows against all rows."""
    width = max((len(x) for _, _, x in rows if x is not None), default=0)
    first = {}
    for vec_id, label, x in rows:
        if None in (vec_id, label, x) or None in x:
            continue
        first[vec_id] = min(first.get(vec_id, (label, x)), (label, x))
    padded = {i: (label, list(x) + [0] * (width - len(x))) for i, (label, x) in first.items()}
    found = set()
    for a, (label, x) in padded.items():
        if not is_anchor(a):
            continue
        scores = [
            (-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, y) in padded.items() if i != a
        ]
        for negative, i, other in sorted(s for s in scores if s[2] == label)[:positives]:
            p = -negative
            inside = sorted(s for s in scores if s[2] != label and low * p <= -100 * s[0] <= high * p)
            for rank, (score, j, _) in enumerate(inside[:negatives], 1):
                found.add((a, i, rank, j, p, -score))
    return found


def mined(spark, rows, is_anchor, **settings):
    frame = spark.createDataFrame(
        [(*row, "s", 1, 2) for row in rows],
        "vec_id long, label long, x array<long>, score string, block int, rank int",
    )
    found = hard_negatives.mine(frame, is_anchor, **settings).collect()
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    tuples = [tuple(r[n] for n in names) for r in found]
    assert len(tuples) == len(set(tuples))
    return set(tuples)


class TestHardNegatives:
    def test_against_all_pairs(self, spark):
        rng = np.random.default_rng(1)
        rows = [
            (int(i), int(rng.integers(3)), [int(v) for v in rng.integers(-20, 21, 6)]) for i in range(-40, 260)
        ]
        # Ties: a third of the rows share a vector, each label has some of them.
        rows += [(1000 + i, i % 3, [5, -3, 0, 2, 0, 1]) for i in range(150)]
        got = mined(spark, rows, F.col("vec_id") % 10 == 0)
        assert got and got == plain_negatives(rows, lambda i: i % 10 == 0)

    def test_odd_rows(self, spark):
        rows = [
            (0, 1, [0, 0]), (10, 1, [3]), (20, 1, []), (30, 1, [3, 4]), (1, 1, [3, 3]), (2, 2, [2, 2]),
            (3, 2, [1, 2]), (4, None, [1, 1]), (None, 1, [9, 9]), (5, 2, None), (6, 2, [1, None]),
            (7, 1, [-3, -4]), (8, 2, [2, 2]), (8, 2, [2, 2]), (30, 1, [9, 9]), (9, 3, [0, 0, 0]),
        ]
        got = mined(spark, rows, F.col("vec_id") % 10 == 0)
        assert got and got == plain_negatives(rows, lambda i: i % 10 == 0)

    def test_nothing(self, spark):
        assert mined(spark, [], F.col("vec_id") % 10 == 0) == set()
        assert mined(spark, [(10, 1, [2])], F.col("vec_id") % 10 == 0) == set()
        assert mined(spark, [(10, 1, [2]), (11, 2, [2])], F.col("vec_id") % 10 == 0) == set()
        assert mined(spark, [(1, 1, [2]), (2, 1, [2]), (3, 2, [1])], F.col("vec_id") % 10 == 0) == set()

    def test_scores_beyond_doubles_are_exact(self, spark):
        big = (1 << 30) - 1
        rows = [(0, 1, [big]), (1, 1, [big]), (2, 2, [big // 2]), (3, 2, [big // 2 + 1]), (4, 2, [big // 2])]
        assert mined(spark, rows, F.col("vec_id") == 0) == plain_negatives(rows, lambda i: i == 0)

    def test_too_large(self, spark):
        with pytest.raises(Exception, match="do not fit"):
            mined(spark, [(0, 1, [1 << 40]), (1, 1, [1])], F.col("vec_id") == 0)

    def test_lists_are_left_early(self):
        """Where one dimension decides, the bound falls below the k-th score long before the lists end."""
        n = 4096
        entries = np.zeros((n, 2), np.int32)
        entries[:, 0] = np.arange(n)
        lists = np.argsort(entries, axis=0, kind="stable").T.astype(np.int32)
        block = hard_negatives.Block(np.arange(n), np.ones(n, np.int64), entries, lists)
        scored = []
        plain = block.scores
        block.scores = lambda rows, anchor: scored.append(len(rows)) or plain(rows, anchor)
        ((first, *_),) = block.best(np.array([3, 0]), np.ones(n, bool), [(0, 1 << 40)], 5)
        assert first == (n - 1, 3 * (n - 1)) and sum(scored) < 100
        # A window below: the lists are read down to it, not to their end.
        found = block.best(np.array([3, 0]), np.ones(n, bool), [(0, 3 * 4000)], 2)
        assert found == [[(4000, 12000), (3999, 11997)]] and sum(scored) < n


class TestBidiagonal:
    @pytest.mark.parametrize(
        "name, matrix",
        [
            ("random", np.random.default_rng(0).standard_normal((40, 40))),
            ("identity", np.eye(12)),
            ("graded", np.random.default_rng(1).standard_normal((20, 20)) * 10.0 ** np.linspace(0, -10, 20)),
            ("low rank", np.outer(np.arange(9.0), np.ones(9)) + np.outer(np.ones(9), np.arange(9.0))),
            ("clusters", np.diag([3.0] * 8 + [3 + 1e-9] * 8 + [1.0] * 4)),
            ("one", np.array([[-2.0]])),
            ("repeated columns", np.tile(np.random.default_rng(2).standard_normal((12, 6)), (1, 2))),
        ],
    )
    def test_against_lapack(self, name, matrix):
        values, vectors = bidiagonal.principal(matrix, len(matrix))
        want = np.linalg.svd(matrix, compute_uv=False)
        want = want[want > len(matrix) * bidiagonal.EPS * want[0]]
        assert len(values) == len(want) and np.allclose(values, want, rtol=1e-10)
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-10
        scale = values[0] ** 2
        assert np.abs(matrix.T @ (matrix @ vectors) - vectors * values**2).max() < 1e-12 * scale

    def test_small_values_of_a_bidiagonal_keep_their_digits(self):
        # det = product of the diagonal; all digits of the smallest value follow from it.
        diagonal, above = 10.0 ** -np.arange(0, 30, 3.0), np.full(9, 0.5)
        values = bidiagonal.singular_values(diagonal, above * diagonal[:-1])
        assert math.isclose(np.prod(values / diagonal), 1.0, rel_tol=1e-12)

    def test_zero(self):
        values, vectors = bidiagonal.principal(np.zeros((3, 3)), 3)
        assert len(values) == 0 and vectors.shape == (3, 0)


def whitened(spark, rows, components=8, fill=0, parts=7):
    frame = spark.createDataFrame(
        [(*row, "w", 3) for row in rows], "vec_id long, x array<long>, white string, n int"
    )
    return whitening.whiten(frame.repartition(parts), components, fill).toPandas()


class TestWhitening:
    def against_numpy(self, got, x, components):
        n = len(x)
        sums = x.sum(axis=0)
        assert set(got["n"]) == {n}
        deviation = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(axis=1)
        first = got.drop_duplicates("vec_id").sort_values("vec_id")
        assert list(first["deviation"]) == list(deviation)
        centred = (n * x - sums) / n
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        want = centred @ vectors / np.sqrt(values)
        found = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
        found = found * np.sign((found * want).sum(axis=0))
        assert np.abs(found - want).max() < 1e-8
        explained = got.drop_duplicates("component").sort_values("component")["explained"]
        assert np.allclose(explained, values / np.trace(centred.T @ centred / n), rtol=1e-9)
        assert got["identity_error"].max() < 1e-9

    def test_against_numpy(self, spark):
        rng = np.random.default_rng(3)
        x = (rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12)) * 500).astype(np.int64) + 100_000
        # A third of all rows are the same vector.
        x[:100] = x[0]
        got = whitened(spark, [(i, [int(v) for v in row]) for i, row in enumerate(x)])
        self.against_numpy(got, x, 8)

    def test_registered_query(self, spark, sf_dir):
        found = duckdb.sql(f"SELECT embedding FROM '{sf_dir}/embeddings.parquet' ORDER BY vec_id").fetchall()
        x = np.floor(1024 * np.array([e for (e,) in found], float)).astype(np.int64) + 100_000
        self.against_numpy(queries.op12_qd_whitening(spark, sf_dir).toPandas(), x, 8)

    def test_odd_rows(self, spark):
        rows = [(1, [4, 1]), (1, [4, 1]), (None, [2]), (3, None), (4, [1, None]), (5, []), (6, [7, 5])]
        got = whitened(spark, rows, fill=2)
        assert len(got) == 10 and set(got["n"]) == {5} and set(got["component"]) == {1, 2}
        x = np.array([[4, 1], [4, 1], [2, 2], [2, 2], [7, 5]])
        deviations = sorted(int(v) for v in ((5 * x - x.sum(axis=0)) ** 2).sum(axis=1))
        assert sorted(got[got["component"] == 1]["deviation"]) == deviations
        assert got["identity_error"].max() < 1e-12

    def test_no_variance(self, spark):
        assert len(whitened(spark, [])) == 0
        assert len(whitened(spark, [(1, [5, 5])])) == 0
        assert len(whitened(spark, [(i, [5, 5]) for i in range(20)])) == 0
        # One dimension varies: one component.
        got = whitened(spark, [(i, [5, i]) for i in range(20)])
        assert set(got["component"]) == {1} and np.allclose(got["explained"], 1)

    def test_large_entries(self, spark):
        big = 1 << 50
        got = whitened(spark, [(0, [big]), (1, [-big]), (2, [0])]).sort_values("vec_id")
        assert got["deviation"].isna().tolist() == [True, True, False]
        assert np.allclose(np.abs(got["whitened"]), [math.sqrt(1.5), math.sqrt(1.5), 0])


def plain_grams(text):
    """Three characters of each word with a space before and behind it."""
    words = "".join(c.lower()[0] if c.isalpha() else " " for c in text).split()
    return [f" {w} "[i : i + 3] for w in words for i in range(len(w))]


class TestLanguage:
    @pytest.mark.parametrize("text", ["Ab c", "a", "x1y", "--é--ÜB ", "日本 語", "İstanbul ǅ", "a\u0000b\n😀c"])
    def test_grams(self, text):
        found = language.grams(text)
        mask = (1 << language.CODE_BITS) - 1
        plain = ["".join(chr((int(g) >> s) & mask) for s in (42, 21, 0)) for g in found]
        assert plain == plain_grams(text)

    @pytest.mark.parametrize("text", [None, "", " \n", "123 ,.", "😀", "́"])
    def test_no_letters(self, text):
        assert language.grams(text) is None

    def test_lone_surrogates(self):
        assert language.grams("a\ud800b") is not None

    def test_masks_against_sets(self, spark):
        """Whatever a filter should hold is found, and chance hits stay near the rate that is taken away."""
        texts = {"xa": "abra kadabra", "xb": "hokus pokus", "xc": "abra pokus"}
        rows = [(t, lang) for lang, t in texts.items() for _ in range(3)]
        model = language.learn(spark.createDataFrame(rows, "text string, lang string"))
        for i, lang in enumerate(model.languages):
            own = language.grams(texts[lang])
            assert model.hits(own)[i] == pytest.approx(len(own), rel=1e-3)
        assert model.predict("kadabra")[0] == "xa" and model.predict("hokus")[0] == "xb"

    def test_false_positives_are_taken_away(self):
        """A filter as small as this hits by chance all the time."""
        rng = np.random.default_rng(5)
        words = np.zeros((1, 1 << 10), np.int64)
        at = language.positions(rng.integers(0, 1 << 60, 300, dtype=np.uint64), 1 << 10, 2).ravel()
        words[0, at] |= 1
        model = language.Model(["a"], words, 2)
        others = rng.integers(0, 1 << 60, 20_000, dtype=np.uint64)
        assert 0.1 < model.false[0] < 0.4
        assert model.hits(others)[0] < 0.05 * len(others)

    def test_many_languages(self, spark):
        """More languages than bits in a word."""
        rows = [(chr(0x4E00 + i) * 5, f"l{i:03}") for i in range(150) for _ in range(2)]
        frame = spark.createDataFrame(rows, "text string, lang string")
        model = language.learn(frame)
        assert model.words.shape[0] == 3
        found = language.identify(frame, model).collect()
        assert all(r.lang_pred == r.lang and r.score > 0.9 for r in found)

    def test_odd_rows(self, spark):
        rows = [
            (1, "one two three", "en", 5), (1, "one two three", "en", 5), (2, None, "en", 5), (3, "", None, 5),
            (4, "12 !", "fr", 5), (None, "one", "en", 5), (5, "日本", None, 5), (6, "one " * 50_000, None, 5),
        ]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
        found = language.identify(docs, language.learn(docs)).select("doc_id", "lang_pred", "score").collect()
        want = {1: "en", 2: "und", 3: "und", 4: "und", None: "en", 5: "en", 6: "en"}
        assert len(found) == 8 and all(r.lang_pred == want[r.doc_id] and 0 <= r.score <= 1 for r in found)
        assert next(r.score for r in found if r.doc_id == 5) == 0
        empty = docs.limit(0)
        assert language.identify(empty, language.learn(empty)).count() == 0
        found = language.identify(docs, language.learn(empty)).collect()
        assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)}

    def test_too_many_values(self, spark):
        docs = spark.range(1100).selectExpr("'a' AS text", "CAST(id AS STRING) AS lang")
        with pytest.raises(ValueError, match="languages"):
            language.learn(docs)

    def test_partial_counts_add_up(self, spark, monkeypatch):
        monkeypatch.setattr(language, "TABLE", 10)
        import pyarrow as pa

        texts = ["abc de", "abc", "de fg", None, "abc"] * 5
        batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 25), pa.array(texts)], ["lang", "text"])
        total = {}
        for part in language._count(iter([batch])):
            for gram, docs in zip(part.column("gram").to_pylist(), part.column("docs").to_pylist()):
                total[gram] = total.get(gram, 0) + docs
        assert sorted(total.values()) == sorted([15, 15, 15, 10, 10, 5, 5])

    def test_registered_query(self, spark, sf_dir):
        """Held-out rows are those of the rule, and nearly all of them are told right."""
        path = f"{sf_dir}/documents.parquet"
        lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{path}' WHERE lang IS NOT NULL").fetchall())
        found = queries.op13_sliced_language_filters(spark, sf_dir).collect()
        assert len(found) == duckdb.sql(f"SELECT count(*) FROM '{path}'").fetchall()[0][0]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
        held = [r for r in found if r.held_out and r.doc_id in lang]
        right = sum(r.lang_pred == lang[r.doc_id] for r in held)
        assert len(held) > 10 and right >= 0.97 * len(held)
