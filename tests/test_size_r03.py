"""What keeps the rules fast on large tables: words in one pass, small plans, documents dealt out, duplicates folded in sorted partitions."""

import pyarrow as pa

from quillspark.operators import echoes, findings, prose, regions
from quillspark.plans import corpus
from quillspark.sources.chapters import from_text


def test_the_best_repeat_needs_no_shuffle(spark):
    laid = regions.laid_out(from_text(spark, "It was long which measured the morning which measured the air.\n\nNone here."))
    found = echoes.phrase_repeats(laid)
    assert [(r.phrase, r.gap, r.para) for r in found.collect()] == [("which measured the", 1, 0)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_the_best_repeat_is_the_longest_then_the_closest_then_the_first_met():
    # Three words at gap 0 and at gap 1; then four words at gap 2, which are longer.
    three = "red stone wall red stone wall x blue glass door y blue glass door".split()
    assert echoes._best_repeat(three, (4, 3), 2) == (3, 0, 0, 3)
    assert echoes._best_repeat(three + "one big gold ring a b one big gold ring".split(), (4, 3), 2) == (4, 2, 14, 20)
    assert echoes._best_repeat("it is to it is to".split(), (4, 3), 2) is None


def test_plans_stay_small(spark):
    sentences = regions.sentences(regions.laid_out(from_text(spark, "One very two.")))
    assert len(prose.dense_weak_words(sentences)._jdf.queryExecution().optimizedPlan().toString()) < 400_000


def test_documents_of_one_row_group_are_dealt_out(spark, tmp_path):
    spark.createDataFrame([(i, f"Text {i}.") for i in range(50)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for made in (corpus.chapters, corpus.raw_chapters):
        rows = made(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and rows.count() == 50


def test_groups_that_go_over_batches_are_folded_whole():
    rows = [(c, k, s, s + 10, "deterministic", "") for c in range(3) for k in ("echo", "style") for s in range(0, 30, 3)]
    table = pa.table(dict(zip(("chapter_number", "category", "start", "end", "engine", "said"), map(list, zip(*rows)))))
    whole = pa.Table.from_batches(findings._fold_groups(table.to_batches())).to_pylist()
    assert len(whole) == 3 * 2 * 5
    for size in (1, 3, 7, 10, 11):
        assert pa.Table.from_batches(findings._fold_groups(table.to_batches(max_chunksize=size))).to_pylist() == whole
