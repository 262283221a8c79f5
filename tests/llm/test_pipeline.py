import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from wavemill.llm import bpe

from .test_jaccard import reachable
from .test_lines import plain as plain_lines
from .test_mixing import plain_targets
from .test_rules import plain as plain_statistics


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The rows before the first stage and after each, written and read as a job would."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [df.collect() for df in out]


def test_columns_and_order(stages, spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "mix_sources", "tokens"]
    assert all(set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"} for rows in stages[:5])


def test_quality_rules(stages, spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1]}
    for r in stages[0]:
        n, _, _, _, repeated = plain_statistics(r.text)
        if n < 20 or 100 * repeated > 30 * n:
            assert r.doc_id not in kept
        elif r.doc_id in labels and labels[r.doc_id] == 1:
            assert r.doc_id in kept


def test_line_dedup(stages):
    expected = plain_lines(sorted((r.doc_id, r.text) for r in stages[1]))
    assert {r.doc_id: r.text for r in stages[2]} == expected
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_near_duplicates(stages):
    roots = reachable([(r.doc_id, r.text) for r in stages[2]])
    assert sorted(r.doc_id for r in stages[3]) == sorted(k for k, root in roots.items() if k == root)
    assert len({r.doc_id for r in stages[3]}) == len(stages[3])


def test_mix_sources(stages):
    sizes, taken, largest = {}, {}, {}
    n = lambda t: len(t.encode().split())
    for r in stages[3]:
        sizes[r.source] = sizes.get(r.source, 0) + n(r.text)
        largest[r.source] = max(largest.get(r.source, 0), n(r.text))
    for r in stages[4]:
        taken[r.source] = taken.get(r.source, 0) + n(r.text)
    for source, goal in plain_targets(sizes).items():
        assert abs(taken.get(source, 0) - goal) <= largest[source] / 2 + 1e-6


def test_tokens(stages):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(file.read()), special_tokens={})
    assert len(stages[5]) == len(stages[4])
    assert all(r.ids == library.encode_ordinary(r.text) for r in stages[5])


def test_null_and_repeated_rows_pass_through(spark, sf_dir):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "a", 0), (1, text, "en", "a", 0), (None, text, None, None, None), (2, None, None, "b", None), (3, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, sf_dir)
        table.collect()
    assert corpus_pipeline.near_duplicates(spark, docs, sf_dir).filter("doc_id = 1").count() == 1
    assert corpus_pipeline.near_duplicates(spark, docs, sf_dir).filter("doc_id is null").count() == 0
