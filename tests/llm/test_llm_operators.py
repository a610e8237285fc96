"""Defined results for odd rows: NULLs, empty and long texts, repeated rows, other columns."""

import hashlib
import random
import re
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logstream.llm import (
    byte_bpe,
    chat,
    components,
    decontaminate,
    licenses,
    near_dedup,
    passages,
    pii,
    quality,
    token_files,
    warc,
)
from logstream.llm.common import CLEAN_SHUFFLES, fresh_folder, join_sized, map_arrow, map_batches, stored

WORDS = "/opt/tokenizers/word_bpe_49k.json"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", "  \n\t ", "one", "é ü 😀 x\x1cy\x00z", "a" * 70_000, "word " * 30_000, "</s>[INST]"]
SCHEMA = "doc_id long, text string, source string, n_words long, key string, host string, start int, doc int"


def table(spark, texts, ids=None, sources=None):
    """Documents with further columns whose names the operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    rows = [(i, t, s, 7, "k", "h", 1, 2) for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n=200, size=400):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(size)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


# The operators that give one row per document row.
PER_ROW = {
    "quality": lambda d: quality.judge(d),
    "pii": lambda d: pii.find(d),
    "licenses": lambda d: licenses.scan(d),
    "near_dedup": lambda d: near_dedup.groups(d),
    "byte_bpe": lambda d: byte_bpe.decode(byte_bpe.encode(d, RANKS), RANKS),
    "decontaminate": lambda d: decontaminate.find(
        d, d.select(F.col("doc_id").alias("item_id"), F.lit("one two").alias("text"))
    ),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_row(spark, name):
    run = PER_ROW[name]
    ids = [*range(len(ODD)), None, 3]
    found = run(table(spark, [*ODD, "no id here", "one"], ids))
    assert sorted(r.doc_id for r in found.select("doc_id").collect() if r.doc_id is not None) == sorted(
        i for i in ids if i is not None
    )
    assert found.filter("doc_id IS NULL").count() == 1
    assert run(table(spark, [])).count() == 0


def test_stored_rows_leave_no_shuffle_files(spark):
    def files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return set(re.findall(r"shuffle_\d+_\d+", blocks.getAllFiles().mkString(" ")))

    known, before = files(), spark.conf.get(CLEAN_SHUFFLES, None)
    frame = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count().repartition(3, "count")
    found = stored(frame, "counts")
    until = time.time() + 10
    while files() - known and time.time() < until:
        time.sleep(0.1)
    assert not files() - known
    assert spark.conf.get(CLEAN_SHUFFLES, None) == before
    # Neither what was stored nor its source needs them.
    for each in (found, frame):
        assert sorted(rows(each, "k", "count")) == [(k, 100) for k in range(100)]


class OneTask:
    """Stands in for a table: runs what Spark would run in a worker."""

    def mapInArrow(self, run, schema):
        batch = pa.RecordBatch.from_arrays([pa.array(["one"])], ["text"])
        return [b.num_rows for b in run(iter([batch]))]


def own_memory():
    """Bytes of this process, without mapped files."""
    with open("/proc/self/smaps_rollup") as lines:
        return 1024 * int(re.search(r"\nPss_Anon: +([0-9]+)", lines.read())[1])


class TestWorkerMemory:
    """Spark keeps idle workers: what a step leaves in them adds up."""

    @pytest.mark.parametrize("by", [map_arrow, map_batches])
    def test_a_worker_gives_back_what_a_step_took(self, by):
        left, most = [], []

        def filled(batch):
            # Blocks of the C library, and one that stays behind them and keeps it from shrinking.
            taken = [np.ones(100_000, np.uint8) for _ in range(2000)]
            left.append(np.ones(100_000, np.uint8))
            most.append(own_memory())
            del taken
            return batch

        def each(batches):
            yield from map(filled, batches)

        before = own_memory()
        assert by(OneTask(), filled if by is map_batches else each, "text string") == [1]
        assert most[0] > before + 100_000_000
        assert own_memory() < before + 50_000_000


class TestQuality:
    def test_measures(self):
        assert quality.measure("a b c a b c d") == (7, 7, 0, 0, 6)
        assert quality.measure("x #\n\nx #\n \nx #\r") == (6, 6, 3, 1, 6)
        assert quality.measure("") == (0, 0, 0, 0, 0)
        assert quality.measure("é ü") == (1, 3, 0, 0, 0)

    def test_bad_host_takes_its_good_documents_along(self, spark):
        good, bad = prose(1), "too short"
        texts = [good] * 60 + [bad] * 55 + [good] * 5 + [good, bad]
        sources = ["fine"] * 60 + ["junk"] * 60 + [None, None]
        docs = table(spark, texts, sources=sources)
        kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
        assert kept == {*range(60), 120}
        left = quality.keep_good(docs)
        assert left.columns == docs.columns
        assert {r.doc_id for r in left.collect()} == kept

    def test_alike_hosts_are_not_judged(self, spark):
        texts = [prose(i) if i % 3 else "short" for i in range(90)]
        judged = quality.judge(table(spark, texts, sources=[f"s{i // 30}" for i in range(90)]))
        assert judged.filter("kept").count() == 60


class TestTokenFiles:
    def test_files_hold_the_plain_ids(self, spark):
        from tokenizers import Tokenizer

        texts = [*ODD, "I'm THE 12 cats' ₂ İ Σς"]
        ids = [5, 3, None, 3, -8, 9, 1, 2, 0]
        folder = fresh_folder(spark, "test-tokens")
        token_files.write(table(spark, texts, ids), folder, WORDS, 2)
        found = token_files.read(spark, folder).orderBy("start").collect()
        assert [r.doc_id for r in found] == sorted(ids, key=lambda i: (i is not None, i))
        assert [r.start for r in found] == [sum(r.n_tokens for r in found[:n]) for n in range(len(found))]
        plain = Tokenizer.from_file(WORDS)
        lengths = {i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in zip(ids, texts)}
        assert all(r.n_tokens == lengths[r.doc_id] for r in found if r.doc_id != 3)
        parts = [r.asDict() for r in token_files.manifest(spark, folder).collect()]
        assert sum(r["n_docs"] for r in parts) == len(ids)
        for row in parts:
            for _, offsets, stored in token_files.documents(folder, row, 2):
                assert len(stored) == offsets[-1] - offsets[0]

    def test_empty_table(self, spark):
        folder = fresh_folder(spark, "test-tokens")
        assert token_files.write(table(spark, []), folder, WORDS, 2).count() == 0
        assert token_files.read(spark, folder).count() == 0

    def test_forgetting_chunks_changes_nothing(self, monkeypatch):
        texts = [prose(i) for i in range(6)]
        whole = token_files.Encoder(WORDS).encode(texts)
        monkeypatch.setattr(token_files, "KNOWN_CHUNKS", 10)
        small = token_files.Encoder(WORDS)
        assert [small.encode([t])[0] for t in texts] == whole


class TestDecontaminate:
    ITEMS = [(1, prose(90, 14)), (2, "Short Item!"), (3, None), (None, "no id at all"), (4, prose(90, 14))]

    def found(self, spark, texts, **options):
        bench = spark.createDataFrame(self.ITEMS, "item_id long, text string")
        return decontaminate.find(table(spark, texts), bench, **options)

    def brute(self, text):
        words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
        hit, items = set(), set()
        for item, body in self.ITEMS:
            own = re.findall(r"[0-9a-z]+", (body or "").lower())
            size = min(10, len(own))
            windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
            for i in range(len(words)):
                if item is not None and tuple(words[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    items.add(item)
        joined = ",".join(sorted(map(str, items)))
        return len(words), len(hit), len(items), hashlib.sha256(joined.encode()).hexdigest()

    @pytest.mark.parametrize("block", [100_000, 3])
    def test_against_every_place(self, spark, block):
        item = prose(90, 14)
        texts = [
            *ODD[:5],
            item,
            f"x {item.upper()} y",
            " ".join(item.split()[:9]),
            " ".join(item.split()[2:12]) + " short, item; " + item,
            "short short item item",
            prose(90, 13) + " " + prose(4),
        ]
        found = self.found(spark, texts, block_windows=block)
        columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256")
        want = sorted(((i, *self.brute(t)) for i, t in enumerate(texts)), key=repr)
        assert rows(found, *columns) == want

    def test_clean_rows_stay_as_they_are(self, spark):
        bench = spark.createDataFrame(self.ITEMS, "item_id long, text string")
        docs = table(spark, [None, "a short item", "clean"])
        for block in (100_000, 3):
            kept = decontaminate.keep_clean(docs, bench, block_windows=block)
            assert kept.columns == docs.columns
            assert sorted(r.doc_id for r in kept.collect()) == [0, 2]

    def test_empty_benchmark(self, spark):
        bench = spark.createDataFrame([], "item_id long, text string")
        assert decontaminate.find(table(spark, ["a b"]), bench).first().n_hit == 0


class TestNearDedup:
    def test_groups(self, spark):
        base = prose(7, 300).split()
        chain = [base[i * 6 : 240 + i * 6] for i in range(8)]  # neighbours alike, ends not
        texts = [" ".join(c) for c in chain] + [
            prose(8, 300),
            prose(8, 300).upper(),
            "four words are here",
            "Four  words are\nhere",
            "four words are there",
            None,
            "",
            prose(9, 5),
        ]
        found = dict(rows(near_dedup.groups(table(spark, texts)), "doc_id", "component_id"))
        assert [found[i] for i in range(16)] == [0] * 8 + [8, 8, 10, 10, 12, 13, 14, 15]

    def test_many_copies_in_one_bucket(self, spark):
        base = prose(3, 300, 5000).split()
        texts = []
        for i in range(150):
            own = list(base)
            own[i * 2] = f"changed{i}"
            texts.append(" ".join(own))
        kept = near_dedup.keep_one(table(spark, texts + [prose(5)]))
        assert sorted(r.doc_id for r in kept.collect()) == [0, 150]

    def test_pivots_find_links_that_the_first_star_misses(self, spark):
        # b and c are linked with each other, a with neither.
        a = prose(3, 400, 5000).split()
        b = list(a)
        for i in range(0, 200, 8):
            b[i] = f"b{i}"
        c = list(b)
        c[390] = "c"
        texts = [" ".join(x) for x in (a, b, c)]
        settings = near_dedup.Settings(rows=1)
        found = dict(rows(near_dedup.groups(table(spark, texts), settings), "doc_id", "component_id"))
        assert found == {0: 0, 1: 1, 2: 1}

    @pytest.mark.parametrize("few", [32, 2])
    def test_families_against_all_pairs(self, spark, monkeypatch, few):
        """Copies of copies, near and far, so that many are linked with others than the pivot."""
        monkeypatch.setattr(near_dedup, "FEW", few)
        rng = random.Random(12)

        def edited(words, n):
            own = list(words)
            for place in rng.sample(range(len(own)), n):
                own[place] = f"e{rng.randrange(10**9)}"
            return own

        base = prose(3, 200, 5000).split()
        family = [base] + [edited(base, rng.randrange(1, 14)) for _ in range(60)]
        for _ in range(40):
            family.append(edited(rng.choice(family), rng.randrange(0, 6)))
        family += [own[: rng.randrange(150, 200)] for own in rng.sample(family, 15)]
        sets = near_dedup.shingle_sets([" ".join(own) for own in family])
        root = list(range(len(family)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for b in range(len(family)):
            for a in range(b):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
        found = near_dedup.groups(table(spark, [" ".join(own) for own in family]))
        want = [(i, find(i)) for i in range(len(family))]
        assert len({r for _, r in want}) > 10
        assert rows(found, "doc_id", "component_id") == sorted(want, key=repr)

    def test_limits_prune_what_is_surely_apart(self):
        settings = near_dedup.Settings()
        limits = near_dedup.least_matches(settings)
        assert len(limits) == 6 and limits == sorted(limits)
        # The greatest count pruned still has a posterior below the miss probability.
        assert 0.45 * 32 < limits[0] < 0.85 * 32
        assert limits[-1] < 0.85 * 192

    def test_estimate_is_unbiased(self):
        rng = np.random.default_rng(1)
        turns = rng.integers(0, 1 << 32, 2000, np.uint32)
        factors = rng.integers(0, 1 << 32, 2000, np.uint32) | np.uint32(1)
        a = rng.integers(0, 1 << 64, 300, np.uint64)
        b = np.concatenate((a[:240], rng.integers(0, 1 << 64, 60, np.uint64)))
        same = near_dedup.signature(a, turns, factors) == near_dedup.signature(b, turns, factors)
        assert abs(same.mean() - 240 / 360) < 0.04

    @pytest.mark.parametrize("few", [0, components.FEW_LINKS])
    def test_components(self, spark, monkeypatch, few):
        monkeypatch.setattr(components, "FEW_LINKS", few)
        links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3), (60, 50)]
        found = dict(rows(components.components(spark.createDataFrame(links, "a long, b long")), "node", "root"))
        assert found == {**{i: 0 for i in range(1, 41)}, 101: 100, 60: 50}


    def test_many_texts_are_split_in_little_memory(self):
        texts = [prose(i, 300) for i in range(1000)]
        near_dedup.shingle_sets(texts[:2])
        tracemalloc.start()
        sets = near_dedup.shingle_sets(texts)
        held, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert most < held + 6_000_000
        for text, one in zip(texts[:200], sets):
            assert one.tolist() == near_dedup.shingle_sets([text])[0].tolist()


class TestPassages:
    def test_fuzzy_passage(self, spark):
        shared = prose(50, 60, 5000).split()
        changed = list(shared)
        changed[30:31] = ["other", "words"]
        texts = [
            prose(1, 80, 5000) + " " + " ".join(shared) + " " + prose(2, 80, 5000),
            prose(3, 40, 5000) + " " + " ".join(changed) + " " + prose(4, 90, 5000),
            prose(5, 200, 5000),
            None,
            "",
        ]
        found = passages.find(table(spark, texts)).collect()
        assert [(r.doc_id, r.other_id) for r in found] == [(1, 0)]
        row = found[0]
        assert (row.start, row.end, row.other_start, row.other_end, row.matched) == (40, 101, 80, 140, 59)

    def test_passage_in_pieces_of_two_documents(self, spark):
        shared = prose(50, 60, 5000).split()
        texts = [
            prose(1, 80, 5000) + " " + " ".join(shared[:30]),
            prose(2, 80, 5000) + " " + " ".join(shared),
            prose(3, 80, 5000) + " " + " ".join(shared),
        ]
        found = passages.find(table(spark, texts)).collect()
        assert {(r.doc_id, r.passage_start, r.passage_end) for r in found} == {(2, 80, 140)}
        assert {r.other_id for r in found} == {0, 1}

    def test_passage_whose_seeds_stand_alone_in_smaller_documents(self, spark):
        shared = prose(50, 60, 5000).split()
        grams = [" ".join(shared[i : i + 5]) for i in range(56)]
        # Each five words also in small documents, and apart in a long one; often enough to be a seed there.
        texts = [
            f"{prose(1000 + 20 * i + n, 30, 5000)} {gram} {prose(9000 + 20 * i + n, 30, 5000)}"
            for i, gram in enumerate(grams)
            for n in range(12)
        ]
        long = [" ".join(texts)]
        pair = [f"{prose(n, 80, 5000)} {' '.join(shared)} {prose(n + 2, 80, 5000)}" for n in (1, 2)]
        for given in (texts + pair, long + pair):
            found = passages.find(table(spark, given)).collect()
            assert {(len(given) - 1 - r.doc_id, r.start, r.end) for r in found} == {(0, 80, 140)}

    def test_changed_passage_whose_seeds_stand_in_smaller_documents(self, spark):
        """Every 20th of 79 words is changed, so no equal run is longer than 19 words."""
        shared = prose(50, 79, 5000).split()
        changed = [f"c{i}" if i % 20 == 19 else word for i, word in enumerate(shared)]
        texts = [
            f"{prose(1000 + 20 * i + n, 30, 5000)} {' '.join(shared[i : i + 5])} {prose(9000 + 20 * i + n, 30, 5000)}"
            for i in range(75)
            for n in range(12)
        ]
        texts += [
            f"{prose(n, 80, 5000)} {' '.join(own)} {prose(n + 2, 80, 5000)}" for n, own in ((1, shared), (2, changed))
        ]
        found = passages.find(table(spark, texts)).collect()
        here = [r for r in found if r.doc_id == 901]
        covered = {place for r in here for place in range(r.start, r.end)}
        assert covered >= set(range(80, 159))

    def test_changed_passages_are_found(self, spark):
        """Planted passages with words changed, put in and left out, as far as they agree to 0.8."""
        rng = random.Random(11)
        texts, planted = [], set()
        while len(planted) < 60:
            own = prose(100 + len(texts), rng.randrange(50, 140), 5000).split()
            other = list(own)
            for at in range(rng.randrange(8, 30), len(own) - 8, rng.randrange(22, 45)):
                other[at : at + rng.choice((0, 1, 1))] = [f"n{at}"] if rng.random() < 0.7 else []
            grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (own, other)]
            if len(grams[0] & grams[1]) < 0.8 * len(grams[0] | grams[1]):
                continue
            planted.add((len(texts) + 1, len(texts)))
            for words in (own, other):
                seed = 10_000 + 2 * len(texts)
                texts.append(f"{prose(seed, 70, 5000)} {' '.join(words)} {prose(seed + 1, 70, 5000)}")
        found = {(r.doc_id, r.other_id) for r in passages.find(table(spark, texts)).collect()}
        assert found <= planted and len(found) >= 0.9 * len(planted)

    def test_run_with_chance_anchors_far_from_its_own(self, spark):
        shared = prose(50, 300, 5000).split()
        grams = [" ".join(shared[i : i + 5]) for i in range(40, 296)]
        texts = [" ".join(f"{gram} {prose(1000 + 20 * i + n, 30, 5000)}" for i, gram in enumerate(grams) for n in range(12))]
        texts += [f"{prose(n, 80, 5000)} {' '.join(shared)} {prose(n + 2, 80, 5000)}" for n in (1, 2)]
        covered = set()
        for r in passages.find(table(spark, texts)).collect():
            assert r.doc_id == 2
            covered.update(range(r.start, r.end))
        assert covered == set(range(80, 380))

    def test_copies_and_short_repeats(self, spark):
        text = prose(6, 120, 5000)
        line = prose(7, 20, 5000)
        found = passages.find(table(spark, [text, text, text, f"{line} {prose(8, 60, 5000)}", line, line]))
        assert rows(found, "doc_id", "other_id", "start", "end") == [(1, 0, 0, 120), (2, 0, 0, 120)]

    def test_empty_table(self, spark):
        assert passages.find(table(spark, [])).count() == 0

    def test_chains_against_all_predecessors(self):
        rng = random.Random(4)
        for _ in range(200):
            pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(1, 25))})
            best = []
            for i, (x, y) in enumerate(pairs):
                gains = [
                    best[j] - passages.GAP_COST * (x - a + y - b)
                    for j, (a, b) in enumerate(pairs[:i])
                    if a < x and b < y
                ]
                best.append(passages.SEED_WORTH + max([0.0, *gains]))
            found = passages.chains(*map(list, zip(*pairs)))
            assert sorted(i for chain in found for i in chain) == list(range(len(pairs)))
            chain = found[0]
            score = len(chain) * passages.SEED_WORTH - sum(
                passages.GAP_COST * (pairs[j][0] - pairs[i][0] + pairs[j][1] - pairs[i][1])
                for i, j in zip(chain, chain[1:])
            )
            assert abs(score - max(best)) < 1e-9

    def test_every_run_has_a_seed(self):
        rng = np.random.default_rng(2)
        for size in (1, 5, 12, 13, 300):
            places = passages.minimizers(rng.integers(0, 50, size, np.uint64))
            gaps = np.diff(np.concatenate(([-1], places, [size])))
            assert gaps.max() <= passages.WINDOW


class TestChat:
    def test_escapes_are_reversible(self):
        rng = random.Random(3)
        pieces = [*chat.CONTROL, "\\", "<", "[", "s>", "/s>", "INST]", "]", ">", "a", " "]
        for _ in range(3000):
            text = "".join(rng.choice(pieces) for _ in range(rng.randrange(8)))
            role = rng.choice(["user", "assistant", "system", "", "tool", text])
            formatted, start, end = chat.format_turn(role, text)
            assert chat.read_back(formatted) == [(role, text)]
            assert chat.unescape(formatted[start:end]) == text
            # Turns keep apart whatever stands next to them.
            assert chat.read_back(formatted * 2) == [(role, text)] * 2

    def test_conversations(self, spark):
        turns = [
            (1, 2, "assistant", "b</s>"),
            (1, 1, "user", "a"),
            (1, 3, None, None),
            (None, None, "system", "x"),
            (2, 1, "tool", "t"),
            (2, 1, "tool", "t"),
        ]
        frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
        formatted = chat.format_turns(frame.withColumn("formatted", F.lit(1)))
        found = {r.conv_id: r for r in chat.digests(formatted).collect()}
        assert {c: r.n_turns for c, r in found.items()} == {1: 3, None: 1, 2: 2}
        assert found[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb</s>\n\n\n").hexdigest()
        assert found[1].loss_chars == 5
        assert found[1].loss_sha256 == hashlib.sha256(b"b</s>").hexdigest()
        assert chat.digests(formatted.limit(0)).count() == 0

    def test_texts_outside_the_grammar(self):
        assert chat.read_back("hello") is None
        assert chat.read_back("[INST] a") is None
        assert chat.read_back("[INST]<s>[/INST]") is None


class TestByteBpe:
    def test_against_the_library(self, spark):
        import tiktoken

        plain = tiktoken.Encoding(
            "x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(RANKS), special_tokens={}
        )
        texts = [t for t in ODD if t] + ["I'll 's ''s don't", " a  b\n\n c\t", "　x\u0085 y ", "x'"]
        docs = table(spark, texts).repartition(3)
        found = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).collect()
        assert len(found) == len(texts)
        for row in found:
            ids = np.frombuffer(row.ids, "<u4").tolist()
            assert ids == plain.encode_ordinary(texts[row.doc_id])
            assert bytes(row.decoded).decode() == texts[row.doc_id]

    def test_blocks_change_nothing(self, spark, tmp_path):
        path = str(tmp_path / "docs")
        table(spark, [prose(i, 30) for i in range(40)]).repartition(5).write.parquet(path)
        docs = spark.read.parquet(path)
        apart = rows(byte_bpe.encode(docs, RANKS), "doc_id", "ids")
        assert apart == rows(byte_bpe.encode(docs.coalesce(1), RANKS), "doc_id", "ids")

    def test_cuts_follow_the_rows(self, monkeypatch):
        import pyarrow as pa

        monkeypatch.setattr(byte_bpe, "BLOCK_TOKENS", 50)
        monkeypatch.setattr(byte_bpe, "PACK_DOCS", 3)
        texts = [prose(i, 10) for i in range(20)]
        names = ["doc_id", "text", "part"]
        columns = [pa.array(range(20)), pa.array(texts), pa.array([4] * 20)]
        whole = pa.RecordBatch.from_arrays(columns, names)

        def cuts(batches):
            return [(b, tuple(ids or ())) for b, _, ids, _, _ in byte_bpe.blocks(iter(batches))]

        assert cuts([whole]) == cuts([whole.slice(0, 7), whole.slice(7, 0), whole.slice(7)])
        assert {block >> byte_bpe.BLOCK_BITS for block, _ in cuts([whole])} == {4} and len(cuts([whole])) > 9

    def test_pre_tokens_against_the_pattern(self):
        import regex

        pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(5)
        alphabet = " \n\t'srevmltd.A1é 　\0"
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(20))) for _ in range(4000)]
        words, counts = byte_bpe.pre_tokens(texts)
        want = [[w.encode() for w in pattern.findall(t)] for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        assert words == [w for one in want for w in one]

    def test_a_pack_is_split_in_little_memory(self):
        """Every idle worker keeps what its largest step took."""
        rng = random.Random(5)
        texts = [" ".join(str(rng.randrange(100_000)) for _ in range(700)) for _ in range(256)]
        byte_bpe.character_kinds()
        tracemalloc.start()
        words, counts = byte_bpe.pre_tokens(texts)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert b"".join(words).decode() == "".join(texts) and sum(counts) == len(words)
        assert most < 33 * sum(map(len, texts))

    def test_packing(self):
        values = np.array([0, 1, 70_000, 4_000_000_000], np.uint32)
        assert byte_bpe.unsqueeze(byte_bpe.squeeze(values)).tolist() == values.tolist()
        assert byte_bpe.unsqueeze(byte_bpe.squeeze(values[:0])).tolist() == []


class TestWarc:
    def test_pages(self, spark, monkeypatch):
        pages = [
            (3, "http://a/é?x=1\r\nEvil: 1", "<p>same</p>"),
            (1, None, "<p>same</p>"),
            (2, "u", None),
            (5, "u", ""),
            (4, "u", "é" * 50_000),
            (None, "u", "<p>same</p>"),
            (1, "v", "<p>same</p>"),
        ]
        frame = spark.createDataFrame(pages, "page_id long, url string, html string")
        folder = fresh_folder(spark, "test-warc")
        index = warc.write(frame.withColumn("payload", F.lit(1)), folder)
        assert index.count() == len(pages)
        found = warc.read(index, folder)
        assert rows(found, "page_id", "record_type", "refers_to", "payload_bytes") == sorted(
            [
                (3, "revisit", 1, 11),
                (1, "response", None, 11),
                (1, "response", None, 11),
                (None, "revisit", 1, 11),
                (2, "response", None, 0),
                (5, "revisit", 2, 0),
                (4, "response", None, 100_000),
            ],
            key=repr,
        )
        assert found.filter("record_type = 'response'").filter("page_id = 4").first().payload == ("é" * 50_000).encode()
        assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"

    def test_small_payloads_may_stand_alone(self, spark):
        frame = spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string")
        folder = fresh_folder(spark, "test-warc")
        found = warc.read(warc.write(frame, folder, least_bytes=2), folder)
        assert {r.record_type for r in found.collect()} == {"response"}

    @pytest.mark.parametrize("fits", [True, False])
    def test_one_payload_on_half_of_the_rows(self, spark, monkeypatch, fits):
        """Shared digests are broadcast if few; otherwise no aggregate stands right before the join."""
        frame = spark.range(4000).selectExpr(
            "id AS page_id", "'u' AS url", "if(id % 2 = 0, null, concat('p', id % 1500)) AS html"
        )
        size = (lambda large, small, on, how: join_sized(large, small, on, how, 1 << 20 if fits else 1))
        monkeypatch.setattr(warc, "join_sized", size)
        known = {}
        for page, _, html in frame.orderBy("page_id").collect():
            known.setdefault(html or "", page)
        found = warc.with_first(frame)
        assert all(
            (r.first is None) == (known[bytes(r.payload).decode()] == r.page_id)
            and r.first in (None, known[bytes(r.payload).decode()])
            for r in found.collect()
        )
        assert found.count() == 4000
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan

    def test_empty_table(self, spark):
        frame = spark.createDataFrame([], "page_id long, url string, html string")
        folder = fresh_folder(spark, "test-warc")
        assert warc.read(warc.write(frame, folder), folder).count() == 0

    def test_frames_are_independent(self, tmp_path, monkeypatch):
        import pyarrow.fs as pafs
        import zstandard

        monkeypatch.setattr(warc, "FRAME_BYTES", 1500)
        files, path = pafs.LocalFileSystem(), str(tmp_path / "x.warc.zst")
        writer = warc.BundleWriter(files.open_output_stream(path, compression=None))
        data = [warc.record(i, f"u{i}", b"p" * (i * 100), None) for i in range(20)]
        places = [writer.add(one) for one in data]
        writer.close()
        reader = warc.BundleReader(files.open_input_file(path))
        assert len(writer.frames) > 3
        for place, one in reversed(list(zip(places, data))):
            assert reader.record(*place) == one
        # Any reader of the packed format gets all records, the seek table skipped.
        with open(path, "rb") as packed:
            whole = zstandard.ZstdDecompressor().stream_reader(packed, read_across_frames=True).read()
        assert whole == b"".join(data)


class TestPii:
    PATTERNS = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def brute(self, text):
        for kind, pattern in self.PATTERNS.items():
            for found in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", found[0])
                good = {
                    "email": lambda: True,
                    "ip": lambda: all(int(part) <= 255 for part in found[0].split(".")),
                    "card": lambda: 16 <= len(digits) <= 19 and pii.luhn(digits),
                    "phone": lambda: 8 <= len(digits) <= 15,
                }
                if good[kind]():
                    yield kind, *found.span()

    def test_base_against_the_patterns(self):
        rng = random.Random(6)
        texts = ["".join(rng.choice("ab1230.@@+- ()%_5") for _ in range(rng.randrange(60))) for _ in range(20_000)]
        texts += ["4111 1111-1111 1111 x", "a@b.c@d.ef@g.hi", "1.2.3.4.5.6.7.8", "é +1 (22) 333-4444."]
        for text in texts:
            assert [tuple(s)[:3] for s in pii.base_spans(text)] == list(self.brute(text))

    def test_long_runs_take_linear_time(self):
        for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 100_000, "0" * 9000 + ".1.1.1"):
            pii.base_spans(text)

    def test_checksums_and_context(self):
        assert pii.mod_97("GB82 WEST 1234 5698 7654 32") and not pii.mod_97("GB83 WEST 1234 5698 7654 32")
        text = "pay to GB82 WEST 1234 5698 7654 32 now"
        assert pii.joined(pii.further_spans(text)) == "iban:7:34"
        assert pii.further_spans(text.replace("82", "83")) == []
        assert pii.further_spans("my ssn 123-45-6789")[0].kind == "national_id"
        assert pii.further_spans("part 123-45-6789") == []

    def test_further_kinds_are_taken_whole(self):
        def clean(text):
            return pii.redacted(text, pii.base_spans(text) + pii.further_spans(text))

        for secret in ("x" * 65, "q" * 300, "a1" * 31 + "!.-" * 40 + "z", "letters-only"):
            assert clean(f"my password={secret} here") == "my [SECRET] here"
        spaced, plain = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"
        for after in ("BIC", "12", "THEN SOME CAPITAL WORDS", "ABCDEFGHIJKLMNOP"):
            assert clean(f"to {spaced} {after}") == f"to [IBAN] {after}"
            assert clean(f"to {plain} {after}") == f"to [IBAN] {after}"
        assert clean(f"{spaced} GB82 WEST 1234 5698 7654 32, XX12 {plain}") == "[IBAN] [IBAN], XX12 [IBAN]"
        assert clean("378282246310005 0625 1234") == "[SHORT_CARD] 0625 1234"
        assert clean("3782 822463 10005 1234") == "[SHORT_CARD] 1234"
        assert clean("12 378282246310005") == "12 [SHORT_CARD]"
        assert clean("378282246310005 371449635398431") == "[SHORT_CARD] [SHORT_CARD]"
        assert clean("4111 1111 1111 1111") == "[CARD]"

    def test_further_kinds_take_linear_time(self):
        for text in ("1 " * 150_000, "AB12 " * 60_000, "1234 " * 60_000, "password=" * 30_000, "A" * 300_000 + "0"):
            pii.further_spans(text)

    def test_redacted(self, spark):
        docs = spark.createDataFrame([(1, "to a@b.co, 1.2.3.4", 18), (2, None, 0)], "doc_id long, text string, n_chars long")
        assert rows(pii.redact(docs), "doc_id", "text", "n_chars") == [(1, "to [EMAIL], [IP]", 16), (2, None, None)]


    def test_context_decides(self):
        def found(text):
            return [s.kind for s in pii.further_spans(text)]

        # No issuer begins with 17; the last digit is right.
        number = next(str(n) for n in range(1_700_000_000_000, 1_700_000_000_010) if pii.luhn(str(n)))
        assert found(f"at {number} it ran") == []
        assert found(f"my card {number} thanks") == ["short_card"]
        assert found(f"card list, order {number}") == []
        assert found(f"order list, card {number}") == ["short_card"]
        assert found("378282246310005") == ["short_card"]
        assert found("tracking 378282246310005") == []
        assert found("ssn of part 123-45-6789") == []
        assert found("part of ssn 123-45-6789") == ["national_id"]
        # A country's number of the right length stays, whatever stands near.
        assert found("serial GB82 WEST 1234 5698 7654 32") == ["iban"]
        assert found("password=hunter22222") == ["secret"]
        assert found("dummy password=hunter22222") == []

    def test_numbers_that_are_no_cards(self):
        rng = random.Random(9)
        for _ in range(2000):
            stamp = str(rng.randrange(1_500_000_000_000, 1_900_000_000_000))
            assert pii.further_spans(f"started {stamp} and ended") == []
        real = 0
        for _ in range(200):
            head = "37" + "".join(rng.choice("0123456789") for _ in range(12))
            number = next(head + d for d in "0123456789" if pii.luhn(head + d))
            real += [tuple(s)[:3] for s in pii.further_spans(f"a {number} b")] == [("short_card", 2, 17)]
        assert real == 200


class TestLicenses:
    def test_phrases_and_notices(self, spark):
        texts = [
            "ALL rights, reserved. x all rights reserved CC-BY",
            "Licensed under the Apache License, Version 2.0.",
            "licensed under the new apache license version 2 0",
            "licensed under the apache hills",
            "This work is licensed under the GNU General Public License, version 3.",
            "all rights all rights reserved",
            "cc by cc by",
            "ccK by",
            None,
            "all",
        ]
        found = licenses.scan(table(spark, texts))
        columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
        assert rows(found, *columns) == sorted(
            [
                (0, 9, 3, 0, 7, "cc-by,reserved", "cc-by,reserved"),
                (1, 8, 0, None, None, "", "apache-2.0"),
                (2, 9, 0, None, None, "", "apache-2.0"),
                (3, 5, 0, None, None, "", ""),
                (4, 12, 1, 7, 7, "gpl", "gpl,gpl-3.0"),
                (5, 5, 1, 2, 2, "reserved", "reserved"),
                (6, 4, 2, 0, 2, "cc-by", "cc-by"),
                (7, 2, 0, None, None, "", ""),
                (8, 0, 0, None, None, "", ""),
                (9, 1, 0, None, None, "", ""),
            ],
            key=repr,
        )
        scores = dict(rows(found, "doc_id", "score"))
        assert scores[1] == 1.0 and 0.8 <= scores[2] < 1.0 and scores[8] == 0.0

    def test_no_python_on_the_way(self, spark):
        docs = table(spark, ["a"]).limit(1)
        for frame in (licenses.hits(docs), licenses.scan(docs)):
            plan = frame._jdf.queryExecution().toString()
            assert not re.search("Python|Pandas|MapInArrow|ArrowEval", plan)

    def test_stretched_notice_is_none(self, spark):
        notice = max((one.words for one in licenses.NOTICES if one.label == "bsd"), key=len)
        own = notice.split()
        stretched = " ".join(f"{a} {b} x" for a, b in zip(own, own[1:]))
        found = licenses.scan(table(spark, [notice, stretched, f"{stretched} y {notice}"]))
        labels = {r.doc_id: (r.labels, r.score) for r in found.collect()}
        assert labels[0] == ("bsd", 1.0) and labels[2] == ("bsd", 1.0)
        assert labels[1][0] == "" and labels[1][1] < licenses.LEAST_COVER

    def test_added_labels_against_brute_force(self, spark):
        """Notices with words put in, left out and changed, by plain loops over all spans."""
        rng = random.Random(4)
        texts = []
        for number in range(120):
            words = list(rng.choice(licenses.NOTICES).words.split())
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(words))
                change = rng.randrange(3)
                words[at : at + (change > 0)] = [f"n{number}"] if change < 2 else []
                words = words or ["n"]
            texts.append(" ".join([prose(number, 6, 9), *words, prose(number + 1, 6, 9)]))
        found = {r.doc_id: r for r in licenses.scan(table(spark, texts)).collect()}
        told = 0
        for doc, text in enumerate(texts):
            words, labels, best = text.split(), set(), 0.0
            for one in licenses.NOTICES:
                own = one.words.split()
                pairs = list(zip(own, own[1:]))
                places = {}
                for start, pair in enumerate(zip(words, words[1:])):
                    for place in (i for i, p in enumerate(pairs) if p == pair):
                        places.setdefault(start - place, set()).add(place)
                for first in places:
                    covered, last = set(), first
                    for diagonal in sorted(d for d in places if d >= first):
                        if diagonal - last > licenses.GAP or diagonal - first + len(own) > len(own) / licenses.LEAST_COVER:
                            break
                        covered, last = covered | places[diagonal], diagonal
                    cover = len(covered) / len(pairs)
                    best = max(best, cover)
                    if cover >= licenses.LEAST_COVER:
                        labels.add(one.label)
            notices = set(found[doc].labels.split(",")) - set(found[doc].base_labels.split(",")) - {""}
            assert notices == labels - set(found[doc].base_labels.split(","))
            assert found[doc].score == (1.0 if found[doc].n_base else best)
            told += bool(labels)
        assert 30 < told < 115


class TestBlocksOfWords:
    def test_blocks_of_many_partitions(self):
        """Far more splits than a hundred terabytes make, and an error beyond."""
        highest = byte_bpe.block_of((1 << 21) - 1, (1 << 12) - 1)
        assert (highest << byte_bpe.NUMBER_BITS | byte_bpe.ONE_BLOCK) == (1 << 63) - 1
        assert byte_bpe.block_of(2100, 0) != byte_bpe.block_of(2099, 4095)
        for part, made in ((1 << 21, 0), (0, 1 << 12)):
            with pytest.raises(ValueError):
                byte_bpe.block_of(part, made)

    def test_decoding_keeps_other_columns(self, spark):
        ids = [b"", None, np.array([5, 70, 5], "<u4").tobytes()]
        rows = [(i % 3, "x", ids[i % 3], "kept") for i in range(6)]
        encoded = spark.createDataFrame(rows, "id int, decoded string, ids binary, token string")
        found = byte_bpe.decode(encoded, RANKS)
        token = {rank: word for word, rank in byte_bpe.ranks(RANKS).items()}
        want = [b"", None, token[5] + token[70] + token[5]]
        assert found.columns == ["id", "ids", "token", "decoded"]
        got = sorted((r.id, r.token, r.decoded and bytes(r.decoded)) for r in found.collect())
        assert got == [(i, "kept", want[i] or None if i == 1 else want[i]) for i in (0, 0, 1, 1, 2, 2)]
        assert byte_bpe.decode(encoded.limit(0), RANKS).count() == 0
        with pytest.raises(Exception, match="99999999"):
            unknown = [(1, np.array([99999999], "<u4").tobytes())]
            byte_bpe.decode(spark.createDataFrame(unknown, "id int, ids binary"), RANKS).collect()

    def test_a_broadcast_vocabulary_moves_no_batch(self, spark, monkeypatch):
        """Batches meet their tokens where they are; beyond the broadcast limit they travel, with equal results."""
        rows = [(i, np.array([i, 300 + i % 7, i], "<u4").tobytes()) for i in range(2500)]
        encoded = spark.createDataFrame(rows, "id int, ids binary").repartition(3)
        found = {}
        for limit in (byte_bpe.VOCABULARY_ROWS, 10):
            monkeypatch.setattr(byte_bpe, "VOCABULARY_ROWS", limit)
            decoded = byte_bpe.decode(encoded, RANKS)
            moved = "hashpartitioning(batch" in decoded._jdf.queryExecution().executedPlan().toString()
            found[moved] = {r.id: bytes(r.decoded) for r in decoded.collect()}
        token = {rank: word for word, rank in byte_bpe.ranks(RANKS).items()}
        want = {i: token[i] + token[300 + i % 7] + token[i] for i in range(2500)}
        assert found == {False: want, True: want}

    def test_another_order_of_rows_is_noticed(self, spark):
        texts = ["one two three", "four five six"]
        first = table(spark, texts).coalesce(1).select("doc_id", "text", F.lit(0).alias("part"))
        second = first.orderBy(F.desc("doc_id")).coalesce(1)
        words = byte_bpe.encoded_words(byte_bpe.distinct_words(first), RANKS)
        assert byte_bpe.reassembled(words, byte_bpe.positions(first)).count() == 2
        with pytest.raises(Exception, match="do not fit"):
            byte_bpe.reassembled(words, byte_bpe.positions(second)).collect()

    def test_more_splits_than_2047(self, spark):
        docs = table(spark, [f"word {i % 7}" for i in range(2100)]).repartition(2100).cache()
        found = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS)
        got = {(r.doc_id, bytes(r.decoded).decode()) for r in found.collect()}
        docs.unpersist()
        assert got == {(i, f"word {i % 7}") for i in range(2100)}
