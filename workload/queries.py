"""The registered queries: one per operator, over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.functions.text import extract_sql
from querent.functions.vectors import l2_norm, normalize, squared_l2
from querent.operators import bm25, context, corpus, dense, execution, generation, metrics, postings, schema
from querent.plans import experiments
from querent.plans.answering import bm25_hits, dense_hits, generate_sql
from querent.session import new_run_dir
from querent.sources import catalogs, databases, examples, files, results
from workload import inputs

K = 10


def _hits(hits: DataFrame, value: str) -> DataFrame:
    return hits.select("query_id", "rank", "item_id", F.round(value, 4).alias(value))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


# Catalogs and examples


def list_databases(spark, sf):
    return schema.list_databases(inputs.catalog(spark, sf))


def catalog_missing_ids(spark, sf):
    return schema.missing_databases(inputs.catalog(spark, sf), inputs.wanted_databases(spark, sf))


def catalog_columns(spark, sf):
    return schema.flatten_columns(inputs.catalog(spark, sf)).withColumns(
        {name: F.col(name).cast("bigint") for name in ("col_idx", "table_idx")}
    )


def catalog_foreign_keys(spark, sf):
    keys = schema.resolve_foreign_keys(inputs.catalog(spark, sf))
    return keys.withColumn("fk_ord", F.col("fk_ord").cast("bigint"))


def catalog_primary_keys(spark, sf):
    keys = schema.resolve_primary_keys(inputs.catalog(spark, sf))
    return keys.withColumn("pk_ord", F.col("pk_ord").cast("bigint"))


def schema_text(spark, sf):
    return schema.render_schema_text(inputs.catalog(spark, sf))


def retrieval_corpus(spark, sf):
    return corpus.build_retrieval_corpus(inputs.examples(spark, sf), inputs.catalog(spark, sf))


def examples_by_database(spark, sf):
    return corpus.examples_by_database(inputs.examples(spark, sf), "db0", "dev")


def index_corpus(spark, sf):
    return corpus.build_index_corpus(inputs.examples(spark, sf))


def first_n_examples(spark, sf):
    return corpus.take_first(inputs.examples(spark, sf), 100)


def db_counts(spark, sf):
    return metrics.db_counts(inputs.examples(spark, sf))


def top_databases(spark, sf):
    return metrics.top_databases(inputs.examples(spark, sf))


def dataset_summary(spark, sf):
    return metrics.dataset_summary(inputs.examples(spark, sf), inputs.catalog(spark, sf))


# BM25


def token_counts(spark, sf):
    return bm25.token_counts(inputs.documents_corpus(spark, sf))


def bm25_index_stats(spark, sf):
    index = inputs.documents_index(spark, sf)
    stats = index.stats.select("n_docs", "n_tokens", "n_terms", "avgdl", "avg_idf")
    return _rounded(stats, "avgdl", "avg_idf")


def bm25_idf(spark, sf):
    return _rounded(inputs.documents_index(spark, sf).terms, "idf")


def _bm25(spark, sf, **options):
    index, asked = inputs.documents_index(spark, sf), inputs.benchmark_queries(spark, sf)
    return _hits(bm25.bm25_topk(index, asked, K, **options), "score")


def bm25_topk(spark, sf):
    return _bm25(spark, sf, fill=False)


def bm25_topk_global_filled(spark, sf):
    return _bm25(spark, sf)


def bm25_topk_in_db(spark, sf):
    return _bm25(spark, sf, within=True, fill=False)


def bm25_topk_filled(spark, sf):
    return _bm25(spark, sf, within=True)


def _pruned(spark, sf, within):
    index, asked = inputs.documents_index(spark, sf), inputs.benchmark_queries(spark, sf)
    found = inputs.documents_postings(spark, sf)
    return _hits(postings.bm25_topk_pruned(index, found, asked, K, within=within), "score")


def bm25_topk_postings(spark, sf):
    """bm25_topk through inverted postings whose blocks are skipped by their maxima."""
    return _pruned(spark, sf, within=False)


def bm25_topk_in_db_postings(spark, sf):
    return _pruned(spark, sf, within=True)


def _filled(spark, sf, within):
    index, asked = inputs.documents_index(spark, sf), inputs.benchmark_queries(spark, sf)
    found = inputs.documents_postings(spark, sf)
    return _hits(postings.bm25_topk_filled(index, found, asked, K, within=within), "score")


def bm25_topk_global_filled_postings(spark, sf):
    """bm25_topk_global_filled from the postings and the pool of first documents."""
    return _filled(spark, sf, within=False)


def bm25_topk_filled_postings(spark, sf):
    return _filled(spark, sf, within=True)


# Vectors


def hashed_embeddings(spark, sf):
    encoded = dense.embed(inputs.documents_corpus(spark, sf), "text", inputs.ENCODER)
    places = encoded.select("item_id", F.posexplode("v").alias("place", "n"))
    return places.filter(F.col("n") > 0).select(
        "item_id", F.col("place").cast("bigint").alias("place"), "n"
    )


def vector_norms(spark, sf):
    vectors = inputs.table(spark, sf, "embeddings")
    raw, unit = l2_norm(F.col("embedding")), l2_norm(normalize(F.col("embedding")))
    return vectors.select(
        "vec_id", F.round(raw, 6).alias("norm"), F.round(unit, 6).alias("unit_norm")
    )


def vector_distance(spark, sf):
    """Every vector against the mean vector of its label."""
    means = inputs.label_queries(spark, sf).select(
        F.col("query_id").alias("label"), normalize(F.col("v")).alias("mean")
    )
    vectors = inputs.table(spark, sf, "embeddings").join(means, "label")
    distance = squared_l2(normalize(F.col("embedding")), F.col("mean"))
    return vectors.select("vec_id", F.round(distance, 6).alias("distance"))


def vector_index_roundtrip(spark, sf):
    stored = inputs.embeddings_index(spark, sf)
    return stored.select("item_id", "db_id", F.round(l2_norm(F.col("v")), 6).alias("norm"))


def vector_index_values(spark, sf):
    """Every stored number; zero vectors stay zero."""
    stored = inputs.vectors_with_zeros(spark, sf)
    numbers = stored.select("item_id", F.posexplode("v").alias("place", "x"))
    return numbers.select("item_id", F.col("place").cast("bigint").alias("place"), F.round("x", 6).alias("x"))


def _vector_hits(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select(
        *more,
        "query_id",
        "rank",
        "item_id",
        F.round("distance", 4).alias("distance"),
        F.round("similarity", 4).alias("similarity"),
    )


def _vectors(spark, sf, **options):
    index, asked = inputs.embeddings_index(spark, sf), inputs.label_queries(spark, sf)
    return _vector_hits(dense.vector_topk(index, asked, K, **options))


def vector_topk(spark, sf):
    return _vectors(spark, sf)


def vector_topk_postfilter(spark, sf):
    return _vectors(spark, sf, within=True)


def vector_topk_prefilter(spark, sf):
    return _vectors(spark, sf, within=True, mode="pre")


def vector_topk_sweep(spark, sf):
    index, asked = inputs.embeddings_index(spark, sf), inputs.label_queries(spark, sf)
    hits = dense.vector_topk_sweep(index, asked, inputs.KS)
    return _vector_hits(hits.withColumn("k", F.col("k").cast("bigint")), "k")


def text_vector_topk(spark, sf):
    """Encode documents and questions, then search within the language."""
    asked = dense.embed_once(inputs.benchmark_queries(spark, sf), "text", inputs.ENCODER)
    return _vector_hits(
        dense.vector_topk(inputs.documents_vectors(spark, sf), asked, K, within=True)
    )


# Prompts and generated text


def _example_hits(spark, sf):
    index = inputs.examples_index(spark, sf)
    items = corpus.build_index_corpus(inputs.train_examples(spark, sf))
    return bm25_hits(inputs.dev_questions(spark, sf), index, items, K)


def _contexts(spark, sf):
    return context.build_context(
        inputs.dev_questions(spark, sf), schema_text(spark, sf), _example_hits(spark, sf)
    )


def rag_context(spark, sf):
    return _contexts(spark, sf).select("query_id", "db_id", "context")


def prompt_plain(spark, sf):
    asked = inputs.turns(spark, sf)
    return asked.select(
        F.col("idx").alias("query_id"), context.prompt_plain(F.col("question")).alias("prompt")
    )


def prompt_rag(spark, sf):
    text = context.prompt_rag(F.col("question"), F.col("context"))
    return _contexts(spark, sf).select("query_id", text.alias("prompt"))


def prompt_stepwise(spark, sf):
    text = context.prompt_stepwise(F.col("question"), F.col("context"))
    return _contexts(spark, sf).select("query_id", text.alias("prompt"))


def prompts_by_method(spark, sf):
    asked = inputs.dev_questions(spark, sf)
    hits = {
        "bm25": _example_hits(spark, sf),
        "dense": dense_hits(asked, inputs.examples_vectors(spark, sf), inputs.ENCODER, K),
    }
    prompts = context.prompt_configs(asked, schema_text(spark, sf), hits)
    return prompts.select("query_id", "method", "prompt")


def responses_join(spark, sf):
    """Stored answers for the prompts of all user turns; some have none."""
    asked = inputs.turns(spark, sf).select(
        F.col("idx").alias("query_id"), context.prompt_plain(F.col("question")).alias("prompt")
    )
    stored = inputs.answers(spark, sf).select(
        inputs.turn_id().alias("query_id"), F.col("query").alias("response")
    )
    answered = generation.generate(asked, generation.from_stored(stored))
    return answered.select("query_id", "response")


def extracted_sql(spark, sf):
    made = inputs.responses(spark, sf)
    return made.select("query_id", extract_sql(F.col("response")).alias("sql"))


def generated_by_function(spark, sf):
    """Responses of a plugged-in function to the prompts of all user turns."""
    prompts = prompt_plain(spark, sf)
    call = generation.from_function(lambda: lambda texts: [f"SELECT {len(t)}" for t in texts])
    return generation.generate(prompts, call).select("query_id", "response")


# Execution


def _runs(spark, sf):
    pairs = inputs.statement_pairs(spark, sf)
    statements = execution.statements_of(pairs)
    return pairs, execution.run_statements(statements, inputs.databases(spark, sf))


def run_statements(spark, sf):
    _, runs = _runs(spark, sf)
    counts = runs.rows.groupBy("stmt_id").agg(F.count_distinct("row_key").alias("n_rows"))
    counted = runs.outcomes.join(counts, "stmt_id", "left")
    n_rows = F.when(F.col("success"), F.coalesce("n_rows", F.lit(0)))
    return counted.select("db_id", "sql", "success", n_rows.cast("bigint").alias("n_rows"))


def results_equal(spark, sf):
    """Row sets of the statement pairs that both ran."""
    pairs, runs = _runs(spark, sf)
    ran = runs.outcomes.filter("success").select("stmt_id")
    keyed = pairs.select(
        "pair_id",
        execution.statement_id(F.col("db_id"), F.col("gold_sql")).alias("gold_id"),
        execution.statement_id(F.col("db_id"), F.col("generated_sql")).alias("gen_id"),
    )
    for side in ("gold_id", "gen_id"):
        keyed = keyed.join(ran.withColumnRenamed("stmt_id", side), side, "left_semi")
    return execution.results_equal(keyed, runs.rows).select("pair_id", "equal")


def execution_match(spark, sf):
    pairs, runs = _runs(spark, sf)
    return execution.execution_match(pairs, runs).select(
        "pair_id", "execution_match", "gold_success", "gen_success"
    )


def evaluate_methods(spark, sf):
    """Two methods on the same examples: the generated text, and the gold itself."""
    pairs = inputs.statement_pairs(spark, sf)
    copied = F.struct(F.lit("copied").alias("method"), F.col("gold_sql").alias("g"))
    written = F.struct(F.lit("written").alias("method"), F.col("generated_sql").alias("g"))
    both = pairs.select("pair_id", "db_id", "gold_sql", F.inline(F.array(copied, written)))
    detail = execution.evaluate(
        both.withColumnRenamed("g", "generated_sql"), inputs.databases(spark, sf)
    )
    return _rounded(metrics.method_accuracy(detail), "accuracy")


CHAIN = tuple(c for c in context.PROMPT_CONFIGS if c.method in ("baseline", "schema_only", "bm25_rag"))


def _counting(n: Column) -> Column:
    return F.concat(F.lit("SELECT count(*) FROM nation WHERE n_nationkey < "), (n % 7).cast("string"))


def questions_to_accuracy(spark, sf):
    """The whole chain: hits, prompts, generator, extraction, execution, accuracy.

    The generator asks for a number that depends on the length of its prompt, the
    gold statement for one that depends on the question's.
    """
    asked = inputs.dev_questions(spark, sf)
    call = generation.from_function(
        lambda: lambda texts: [f"```sql\nSELECT count(*) FROM nation WHERE n_nationkey < {len(t) % 7};\n```" for t in texts],
        keys=("query_id", "method"),
    )
    made = generate_sql(asked, schema_text(spark, sf), {"bm25": _example_hits(spark, sf)}, call, CHAIN)
    pairs = made.select(
        "method",
        F.col("query_id").alias("idx"),
        "question",
        F.lit("tpch").alias("db_id"),
        _counting(F.length("question")).alias("gold_sql"),
        "generated_sql",
    )
    detail = execution.evaluate(pairs, inputs.databases(spark, sf))
    return _rounded(metrics.method_accuracy(detail), "accuracy")


# Sources and sinks: the given tables written out and read back


def read_examples(spark, sf):
    path = new_run_dir(spark, "examples")
    inputs.examples(spark, sf).drop("split").write.json(path)
    return examples.read_examples(spark, path, "all", layout="lines")


def read_catalog(spark, sf):
    """Every database twice, the first time without keys; the last one counts."""
    path = new_run_dir(spark, "catalog")
    once = inputs.catalog(spark, sf)
    bare = once.withColumns({"primary_keys": F.array().cast("array<bigint>"), "ord": F.lit(1)})
    rows = bare.unionByName(once.withColumn("ord", F.lit(2)))
    rows.write.option("ignoreNullFields", "true").json(path)
    return schema.render_schema_text(catalogs.read_catalog(spark, path, layout="lines"))


def registered_database(spark, sf):
    """Tables written as the folder of a database, checked, registered and asked."""
    root = new_run_dir(spark, "databases")
    for name in ("nation", "customer"):
        inputs.table(spark, sf, name).write.parquet(f"{root}/shop/{name}.parquet")
    files.require_sources(spark, [f"{root}/shop/nation.parquet", f"{root}/shop/customer.parquet"])
    session = databases.register_database(spark, "shop", root)
    return session.sql(
        "SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name"
    )


def method_results_roundtrip(spark, sf):
    path = new_run_dir(spark, "results")
    results.write_method_results(inputs.method_results(spark, sf), path)
    return results.read_method_results(spark, path).select("method", "idx", "execution_match")


def read_method_documents(spark, sf):
    path, rows = new_run_dir(spark, "documents"), inputs.method_results(spark, sf)
    named = rows.withColumnRenamed("idx", "index")
    named.write.partitionBy("method").json(path)
    paths = {m: f"{path}/method={m}" for m in inputs.METHODS}
    read = results.read_method_documents(spark, paths, {"gone": f"{path}/gone"}, layout="lines")
    return read.select("method", "idx", "question", "db_id", "execution_match")


def analysis_document(spark, sf):
    """The summary document of the analysis, as written."""
    path = new_run_dir(spark, "analysis")
    gold = inputs.method_results(spark, sf).withColumn("gold_sql", F.lit("SELECT 1"))
    experiments.analyse(gold, inputs.METHODS, path)
    told = spark.read.json(f"{path}/summary")
    shares = [F.round(f"accuracies.{m}", 6).alias(f"accuracy_{m}") for m in inputs.METHODS]
    only = [F.col(f"unique_successes.{m}").alias(f"only_{m}") for m in inputs.METHODS]
    return told.select("num_examples", "all_failed", "all_succeeded", *shares, *only)


# Analysis


def coverage_gaps(spark, sf):
    """Two methods lack some examples."""
    lacks = (F.col("method") == "bm25_rag") & (F.col("idx") % 7 == 0)
    lacks = lacks | (F.col("method") == "cot_rag") & (F.col("idx") % 11 == 0)
    rows = inputs.method_results(spark, sf).filter(~lacks)
    return metrics.coverage_gaps(rows, inputs.METHODS)


def experiment_summary(spark, sf):
    told = experiments.experiment_summary(inputs.method_results(spark, sf), K, inputs.METHODS)
    return _rounded(told.drop("methods"), "best_accuracy")


def sweep_summary(spark, sf):
    told = experiments.sweep_summary(inputs.k_results(spark, sf), inputs.KS)
    return _rounded(told.select("num_examples", "best_k", "best_accuracy"), "best_accuracy")


def reported_pairs(spark, sf):
    aligned = inputs.aligned_results(spark, sf)
    return metrics.pairwise_methods(aligned, inputs.METHODS, metrics.REPORTED_PAIRS)


def method_accuracy(spark, sf):
    return _rounded(metrics.method_accuracy(inputs.method_results(spark, sf)), "accuracy")


def accuracy_vs_baseline(spark, sf):
    accuracy = metrics.method_accuracy(inputs.method_results(spark, sf))
    return _rounded(metrics.accuracy_vs_baseline(accuracy), "accuracy", "improvement")


def best_method(spark, sf):
    accuracy = metrics.method_accuracy(inputs.method_results(spark, sf))
    best = metrics.best_setting(accuracy, "method", inputs.METHODS)
    return _rounded(best, "accuracy")


def accuracy_by_k(spark, sf):
    return _rounded(metrics.accuracy_by_k(inputs.k_results(spark, sf)), "accuracy")


def best_k(spark, sf):
    accuracy = metrics.accuracy_by_k(inputs.k_results(spark, sf))
    return _rounded(metrics.best_setting(accuracy, "k", inputs.KS), "accuracy")


def method_alignment(spark, sf):
    return inputs.aligned_results(spark, sf)


def unique_successes(spark, sf):
    return metrics.unique_successes(inputs.aligned_results(spark, sf), inputs.METHODS)


def all_failed(spark, sf):
    failed = metrics.all_failed(inputs.aligned_results(spark, sf), inputs.METHODS)
    return metrics.count_and_first(failed).select("idx", "question", "db_id", "total")


def all_succeeded(spark, sf):
    right = metrics.all_succeeded(inputs.aligned_results(spark, sf), inputs.METHODS)
    return metrics.count_and_first(right).select("idx", "question", "db_id", "total")


def pairwise_methods(spark, sf):
    return metrics.pairwise_methods(inputs.aligned_results(spark, sf), inputs.METHODS)


def method_agreement(spark, sf):
    agreement = metrics.method_agreement(inputs.aligned_results(spark, sf), inputs.METHODS)
    return _rounded(agreement, "rate")


QUERIES = {
    f.__name__: f
    for f in (
        list_databases,
        catalog_missing_ids,
        catalog_columns,
        catalog_foreign_keys,
        catalog_primary_keys,
        schema_text,
        retrieval_corpus,
        examples_by_database,
        index_corpus,
        first_n_examples,
        db_counts,
        top_databases,
        dataset_summary,
        token_counts,
        bm25_index_stats,
        bm25_idf,
        bm25_topk,
        bm25_topk_global_filled,
        bm25_topk_in_db,
        bm25_topk_filled,
        bm25_topk_postings,
        bm25_topk_in_db_postings,
        bm25_topk_global_filled_postings,
        bm25_topk_filled_postings,
        hashed_embeddings,
        vector_norms,
        vector_distance,
        vector_index_roundtrip,
        vector_index_values,
        vector_topk,
        vector_topk_postfilter,
        vector_topk_prefilter,
        vector_topk_sweep,
        text_vector_topk,
        rag_context,
        prompt_plain,
        prompt_rag,
        prompt_stepwise,
        prompts_by_method,
        responses_join,
        run_statements,
        results_equal,
        execution_match,
        evaluate_methods,
        method_accuracy,
        accuracy_vs_baseline,
        best_method,
        accuracy_by_k,
        best_k,
        method_alignment,
        unique_successes,
        all_failed,
        all_succeeded,
        pairwise_methods,
        method_agreement,
        generated_by_function,
        questions_to_accuracy,
        read_examples,
        read_catalog,
        registered_database,
        method_results_roundtrip,
        read_method_documents,
        analysis_document,
        coverage_gaps,
        experiment_summary,
        sweep_summary,
        reported_pairs,
    )
} | {"extract_sql": extracted_sql}
