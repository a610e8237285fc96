"""The registered queries on the given tables, against SQL or plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry_points
import check
import corpus_pipeline
from logstream.llm import byte_bpe, pii, queries, quality

WORDS = public_tokenizers.path(queries.WORD_VOCABULARY)
RANKS = public_tokenizers.path(queries.BYTE_RANKS)
LICENSES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@pytest.fixture(scope="module")
def documents(sf_dir):
    found = duckdb.connect().execute(f"SELECT doc_id, text, source FROM '{sf_dir}/documents.parquet'")
    return {doc_id: (text or "", source) for doc_id, text, source in found.fetchall()}


@pytest.fixture(scope="module")
def texts(documents):
    return {doc_id: text for doc_id, (text, _) in documents.items()}


@pytest.fixture(scope="module")
def library():
    import tiktoken

    pattern, ranks = public_tokenizers.PATTERN, byte_bpe.ranks(RANKS)
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_one_query_per_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf_dir, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    want = check.connect(sf_dir).sql(queries.ORACLES[name])
    assert check.compare(frame.toPandas(), want.df()) is None
    assert check.type_differences(frame, want) is None


def test_token_files(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    plain, start = Tokenizer.from_file(WORDS), 0
    found = {r.doc_id: r for r in queries.op1_token_files(spark, sf_dir).collect()}
    assert set(found) == set(texts)
    for doc_id in sorted(texts):
        ids = plain.encode(texts[doc_id], add_special_tokens=False).ids + [queries.END_ID]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        row = found[doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), crc)
        start += len(ids)


def test_byte_bpe(spark, sf_dir, texts, library):
    found = {r.doc_id: r for r in queries.op7_distinct_word_bpe(spark, sf_dir).collect()}
    assert set(found) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array(library.encode_ordinary(text), "<u4")
        row = found[doc_id]
        want = (len(ids), sha(ids.tobytes()), sha(text))
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == want


def test_shared_passages(spark, sf_dir, texts):
    """Every run of fifty words that a smaller document has too is covered."""
    found = queries.op3_chained_passages(spark, sf_dir).collect()
    words = {doc_id: text.encode().lower().split() for doc_id, text in texts.items()}
    first, covered = {}, defaultdict(set)
    for row in found:
        covered[row.doc_id].update(range(row.start, row.end))
        own = words[row.doc_id][row.start : row.end]
        other = words[row.other_id][row.other_start : row.other_end]
        assert row.other_id < row.doc_id and row.matched <= min(len(own), len(other))
        assert row.matched >= 0.8 * max(len(own), len(other))
        assert row.passage_end - row.passage_start >= 40
    for doc_id in sorted(words):
        own = words[doc_id]
        for start in range(len(own) - 49):
            run = tuple(own[start : start + 50])
            if first.setdefault(run, doc_id) != doc_id:
                assert covered[doc_id] >= set(range(start, start + 50))


def base_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, pattern in patterns.items():
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(part) <= 255 for part in match[0].split(".")),
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }
            if good[kind]:
                yield f"{kind}:{match.start()}:{match.end()}"


def test_personal_data(spark, sf_dir, texts):
    found = {r.doc_id: r for r in queries.op9_checked_pii(spark, sf_dir).collect()}
    assert set(found) == set(texts)
    for doc_id, text in texts.items():
        base, row = list(base_spans(text)), found[doc_id]
        kinds = Counter(span.partition(":")[0] for span in base)
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(kinds[k] for k in pii.BASE_KINDS)
        assert row.base_sha256 == sha(",".join(base))
        assert row.spans.startswith(",".join(base))


def test_licenses(spark, sf_dir, texts):
    found = {r.doc_id: r for r in queries.op10_diagonal_licenses(spark, sf_dir).collect()}
    assert set(found) == set(texts)
    for doc_id, text in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
        places, labels = [], set()
        for phrase, label in LICENSES.items():
            own = phrase.split()
            hits = [i for i in range(len(words)) if words[i : i + len(own)] == own]
            places += hits
            labels |= {label} if hits else set()
        row = found[doc_id]
        assert (row.n_words, row.n_base) == (len(words), len(places))
        assert (row.first_word, row.last_word) == ((min(places), max(places)) if places else (None, None))
        assert row.base_labels == ",".join(sorted(labels)) and labels <= set(row.labels.split(","))
        assert 0 <= row.score <= 1 and (not places or row.score == 1)


def test_pipeline(spark, sf_dir, documents, library):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "minhash_near_dedup", "benchmark_decontamination", "personal_data", "byte_level_bpe",
    ]
    # Hosts: none of these tables is bad enough to be rejected as a whole.
    kept = {}
    for doc_id, (text, _) in documents.items():
        n_words, *_, repeated = quality.measure(text)
        if n_words >= 50 and 100 * repeated <= 50 * n_words:
            kept[doc_id] = text
    sets = {}
    for doc_id, text in kept.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    root = {doc_id: doc_id for doc_id in kept}

    def find(doc_id):
        while root[doc_id] != doc_id:
            doc_id = root[doc_id]
        return doc_id

    ordered = sorted(kept)
    for place, a in enumerate(ordered):
        for b in ordered[place + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {doc_id: text for doc_id, text in kept.items() if find(doc_id) == doc_id}
    items = duckdb.connect().execute(f"SELECT text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    letters = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for (text,) in items:
        words = re.findall(letters, ascii_lower(text or ""))
        size = min(10, len(words))
        windows |= {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()
    sizes = {len(w) for w in windows}
    for doc_id in list(kept):
        words = re.findall(letters, ascii_lower(kept[doc_id]))
        if any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1)):
            del kept[doc_id]
    want = {}
    for doc_id, text in kept.items():
        clean = pii.redacted(text, pii.base_spans(text) + pii.further_spans(text))
        ids = np.array(library.encode_ordinary(clean), "<u4")
        want[doc_id] = (len(ids), sha(ids.tobytes()), sha(clean))
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == want
    assert len(found) == len(want)


@pytest.mark.parametrize("place", range(4))
def test_stages_return_the_columns_of_documents(spark, sf_dir, place):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _, stage = corpus_pipeline.STAGES[place]
    for rows in (docs, docs.limit(0)):
        assert stage(spark, rows, sf_dir).schema.names == docs.columns
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
