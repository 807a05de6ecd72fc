"""The same queries in SQL for DuckDB, on the same tables."""

from __future__ import annotations

from querent.functions.text import EXPLANATION_STARTS, STATEMENT_ENDS, STATEMENT_WORDS
from querent.operators.context import PLAIN_TEMPLATE, RAG_TEMPLATE, STEPWISE_TEMPLATE
from querent.operators.metrics import REPORTED_PAIRS
from workload.inputs import KS, METHODS, PLAIN_PAIRS, REGION_PAIRS

K = 10
DIM = 384


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _tokens(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({column}), '\\s+'), lambda w: w <> '')"


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# Inputs

CORPUS = "corpus AS (SELECT doc_id item_id, doc_id corpus_idx, lang db_id, text FROM documents)"
QUERIES = """queries AS (SELECT item_id query_id,
    ['de', 'en', 'es', 'fr'][item_id % 4 + 1] db_id, text FROM benchmark)"""
TURNS = """turns AS (SELECT ((conv_id + turn) * (conv_id + turn + 1)) // 2 + turn idx, conv_id, turn,
    CASE WHEN conv_id % 5 = 0 THEN 'dev' ELSE 'train' END split,
    'db' || (conv_id // 12) db_id, text question FROM conversations WHERE role = 'user'),
answers AS (SELECT conv_id, turn - 1 turn, text query FROM conversations
    WHERE role = 'assistant')"""
EXAMPLES = (
    TURNS
    + """,
examples AS (SELECT split, idx, db_id, question, query FROM turns JOIN answers USING (conv_id, turn))"""
)
TRAIN_CORPUS = """corpus AS (SELECT idx item_id, idx corpus_idx, db_id, question text, question, query
    FROM examples WHERE split = 'train')"""
DEV_QUERIES = """queries AS (SELECT idx query_id, db_id, question text, question
    FROM examples WHERE split = 'dev')"""
PARTS = """parts AS (SELECT p_partkey // 20 n, 'db' || (p_partkey // 20) db_id, p_partkey % 20 pos,
    replace(p_name, ' ', '_') || '_' || (p_partkey % 20) name, lower(p_type) type, p_size FROM part),
fks AS (SELECT a.db_id, row_number() OVER (PARTITION BY a.db_id ORDER BY a.pos) - 1 fk_ord,
    'table_' || (a.pos // 5) from_table, a.name from_column,
    'table_' || (b.pos // 5) to_table, b.name to_column
    FROM parts a JOIN parts b ON a.n = b.n AND b.pos = a.pos - a.pos % 5
    WHERE a.pos % 5 <> 0 AND a.p_size > 25 AND a.n % 3 <> 0),
pks AS (SELECT db_id, row_number() OVER (PARTITION BY db_id ORDER BY pos) - 1 pk_ord,
    'table_' || (pos // 5) "table", name "column" FROM parts WHERE pos % 5 = 0 AND n % 4 <> 1)"""
SCHEMAS = (
    PARTS
    + """,
blocks AS (SELECT d.db_id, d.i, chr(10) || d.name || ':' || chr(10) ||
    coalesce(string_agg('  - ' || p.name || ' (' || p.type || ')' || chr(10), '' ORDER BY p.pos), '') block
    FROM (SELECT db_id, i, CASE WHEN i = 4 THEN 'unused' ELSE 'table_' || i END name
          FROM (SELECT DISTINCT db_id FROM parts), range(5) r(i)) d
    LEFT JOIN parts p ON p.db_id = d.db_id AND p.pos // 5 = d.i GROUP BY d.db_id, d.i, d.name),
fk_text AS (SELECT db_id, string_agg('  - ' || from_table || '.' || from_column || ' -> ' ||
    to_table || '.' || to_column || chr(10), '' ORDER BY fk_ord) t FROM fks GROUP BY db_id),
pk_text AS (SELECT db_id, string_agg('  - ' || "table" || '.' || "column" || chr(10), ''
    ORDER BY pk_ord) t FROM pks GROUP BY db_id),
schemas AS (SELECT b.db_id, 'Database: ' || b.db_id || chr(10) || chr(10) || 'Tables and Columns:' ||
    chr(10) || string_agg(b.block, '' ORDER BY b.i) ||
    coalesce(chr(10) || 'Foreign Keys:' || chr(10) || any_value(f.t), '') ||
    coalesce(chr(10) || 'Primary Keys:' || chr(10) || any_value(p.t), '') schema_text
    FROM blocks b LEFT JOIN fk_text f USING (db_id) LEFT JOIN pk_text p USING (db_id)
    GROUP BY b.db_id)"""
)
OUTCOMES = """outcomes AS (SELECT doc_id idx, source || '/' || doc_id question, lang db_id, n_chars,
    quality = 1 baseline, toxic = 0 AND doc_id % 5 <> 0 schema_only, n_chars > 500 examples_only, lang = 'en' dense_rag,
    n_chars % 2 = 0 bm25_rag, doc_id % 3 = 0 cot_rag FROM documents JOIN labels USING (doc_id)),
results AS (UNPIVOT outcomes ON baseline, schema_only, examples_only, dense_rag, bm25_rag, cot_rag
    INTO NAME method VALUE execution_match)"""
ACCURACY = (
    OUTCOMES
    + """,
accuracy AS (SELECT method, count(*) FILTER (execution_match) correct, count(*) total,
    count(*) FILTER (execution_match) / count(*) accuracy FROM results GROUP BY method)"""
)
RIGHT = " + ".join(f"{m}::INT" for m in METHODS)
K_ACCURACY = """k_accuracy AS (SELECT k::BIGINT k, count(*) FILTER ((n_chars + doc_id) % 50 >= k) correct,
    count(*) total, count(*) FILTER ((n_chars + doc_id) % 50 >= k) / count(*) accuracy
    FROM documents JOIN labels USING (doc_id), range(5, 55, 5) r(k) GROUP BY k)"""

# BM25 and vectors

BM25 = f"""lengths AS (SELECT item_id, corpus_idx, db_id, len({_tokens('text')}) dl FROM corpus),
tf AS (SELECT item_id, term, count(*) tf
    FROM (SELECT item_id, unnest({_tokens('text')}) term FROM corpus) GROUP BY ALL),
st AS (SELECT count(*) n, sum(dl) n_tokens, avg(dl) avgdl FROM lengths),
df AS MATERIALIZED (SELECT term, count(*) df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) idf0
    FROM tf, st GROUP BY term),
mean_idf AS MATERIALIZED (SELECT avg(idf0) mean FROM df),
idf AS (SELECT term, df, CASE WHEN idf0 < 0 THEN 0.25 * mean ELSE idf0 END idf
    FROM df CROSS JOIN mean_idf)"""
SCORES = (
    BM25
    + f""",
asked AS (SELECT query_id, term, count(*) qtf
    FROM (SELECT query_id, unnest({_tokens('text')}) term FROM queries) GROUP BY ALL),
scores AS (SELECT query_id, item_id,
    sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score
    FROM asked JOIN tf USING (term) JOIN idf USING (term) JOIN lengths USING (item_id), st
    GROUP BY ALL)"""
)


def _bm25_hits(within: bool, fill: bool) -> str:
    same = "q.db_id = d.db_id" if within else "true"
    return (
        SCORES
        + f""",
bm25_hits AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id
    ORDER BY round(score, 6) DESC, corpus_idx) rank FROM
    (SELECT q.query_id, d.item_id, d.corpus_idx, coalesce(score, 0) score FROM queries q
     JOIN lengths d ON {same} {'LEFT' if fill else ''} JOIN scores USING (query_id, item_id))
    QUALIFY rank <= {K})"""
    )


def _bm25_topk(within: bool, fill: bool) -> str:
    return _with(
        CORPUS,
        QUERIES,
        _bm25_hits(within, fill),
        select="SELECT query_id, rank, item_id, round(score, 4) score FROM bm25_hits",
    )


def _places(name: str, key: str, source: str) -> str:
    place = f"CAST('0x' || md5(term)[1:8] AS BIGINT) % {DIM}"
    return f"""{name} AS (SELECT {key}, place, count(*)::DOUBLE n FROM
    (SELECT {key}, {place} place FROM
     (SELECT {key}, unnest({_tokens('text')}) term FROM {source})) GROUP BY ALL)"""


TEXT_DISTANCES = (
    _places("item_places", "item_id", "corpus")
    + ",\n"
    + _places("query_places", "query_id", "queries")
    + f""",
item_norm AS (SELECT item_id, sqrt(sum(n * n)) norm FROM item_places GROUP BY item_id),
query_norm AS (SELECT query_id, sqrt(sum(n * n)) norm FROM query_places GROUP BY query_id),
dots AS (SELECT query_id, item_id, sum(i.n * q.n) dot FROM item_places i
    JOIN query_places q USING (place) GROUP BY ALL),
distances AS (SELECT q.query_id, q.db_id, c.item_id, c.corpus_idx, c.db_id item_db_id,
    greatest((a.norm IS NOT NULL)::INT + (b.norm IS NOT NULL)::INT
        - 2 * coalesce(dot / (a.norm * b.norm), 0), 0) distance
    FROM queries q CROSS JOIN corpus c LEFT JOIN query_norm a USING (query_id)
    LEFT JOIN item_norm b USING (item_id) LEFT JOIN dots USING (query_id, item_id)),
dense_hits AS (SELECT query_id, item_id, distance,
    row_number() OVER (PARTITION BY query_id ORDER BY near) rank FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6), corpus_idx) near
     FROM distances QUALIFY near <= {5 * K}) WHERE db_id = item_db_id QUALIFY rank <= {K})"""
)
LABEL_DISTANCES = """items AS (SELECT vec_id item_id, label::BIGINT label,
    list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[],
        embedding::DOUBLE[]))) v FROM embeddings),
means AS (SELECT label, list(x ORDER BY pos) v FROM (SELECT label, pos, avg(x) x FROM
    (SELECT label::BIGINT label, unnest(embedding::DOUBLE[]) x, generate_subscripts(embedding, 1) pos
     FROM embeddings) GROUP BY ALL) GROUP BY label),
label_queries AS (SELECT label query_id,
    list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v FROM means),
near AS (SELECT query_id, item_id, label, distance, row_number() OVER
    (PARTITION BY query_id ORDER BY round(distance, 6), item_id) near FROM
    (SELECT query_id, item_id, label, list_distance(q.v, i.v) ** 2 distance
     FROM label_queries q, items i))"""
OWN_LABEL = "CASE WHEN query_id % 2 = 0 THEN query_id ELSE (query_id + 1) % 10 END"
HIT = "round(distance, 4) distance, round(1 / (1 + distance), 4) similarity"


def _label_hits(select: str) -> str:
    return _with(LABEL_DISTANCES, select=select)


# Prompts

EXAMPLE_TEXT = """string_agg('Example ' || rank || ':' || chr(10) || 'Question: ' || question || chr(10) ||
    'SQL: ' || query || chr(10), chr(10) ORDER BY rank)"""


def _example_text(name: str, hits: str) -> str:
    return f"""{name} AS (SELECT query_id, 'EXAMPLE QUERIES FROM THIS DATABASE:' || chr(10) || chr(10) ||
    {EXAMPLE_TEXT} t FROM {hits} JOIN corpus USING (item_id) GROUP BY query_id)"""


SCHEMA_BLOCK = "'DATABASE SCHEMA:' || chr(10) || schema_text || chr(10)"
CONTEXTS = ",\n".join(
    (
        EXAMPLES,
        SCHEMAS,
        TRAIN_CORPUS,
        DEV_QUERIES,
        _bm25_hits(within=True, fill=True),
        _example_text("bm25_text", "bm25_hits"),
        f"""contexts AS (SELECT query_id, db_id, question,
    concat_ws(chr(10), {SCHEMA_BLOCK}, e.t) context
    FROM queries LEFT JOIN schemas USING (db_id) LEFT JOIN bm25_text e USING (query_id))""",
    )
)


def _prompt(template: str, context: str = "context") -> str:
    """The template as a SQL expression over ``question`` and a context."""
    sql = _text(template)
    for name, value in (("question", "question"), ("context", context)):
        sql = sql.replace("{" + name + "}", f"' || {value} || '")
    return sql


def _context_of(*blocks: str) -> str:
    return f"concat_ws(chr(10), {', '.join(blocks)})"


METHOD_PROMPTS = {
    "baseline": _prompt(PLAIN_TEMPLATE),
    "schema_only": _prompt(RAG_TEMPLATE, _context_of(SCHEMA_BLOCK)),
    "examples_only": _prompt(RAG_TEMPLATE, _context_of("d.t")),
    "dense_rag": _prompt(RAG_TEMPLATE, _context_of(SCHEMA_BLOCK, "d.t")),
    "bm25_rag": _prompt(RAG_TEMPLATE, _context_of(SCHEMA_BLOCK, "b.t")),
    "cot_rag": _prompt(STEPWISE_TEMPLATE, _context_of(SCHEMA_BLOCK, "d.t")),
}
PROMPT_JOINS = """FROM queries LEFT JOIN schemas USING (db_id) LEFT JOIN bm25_text b USING (query_id)
    LEFT JOIN dense_text d USING (query_id)"""

# Extraction

STATEMENT = f"(?:{'|'.join(STATEMENT_WORDS)})\\s+"
STATEMENT_END = f"(?i)\\n(?:{'|'.join(STATEMENT_ENDS)})"
EXPLAINS = f"^(?:{'|'.join(EXPLANATION_STARTS)})"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WRAPPED = " ".join(
    f"WHEN {i} THEN {form}"
    for i, form in enumerate(
        (
            "text",
            "'```sql' || chr(10) || 'SELECT doc FROM corpus WHERE note = ' || text || chr(10) || '```'"
            " || chr(10) || 'This query finds it.'",
            "'Here it is:' || chr(10) || '```SQL' || chr(10) || 'select 1;' || chr(10) || '```'"
            " || chr(10) || text",
            "text || chr(10) || 'SELECT a, b FROM t;;' || chr(10) || 'Explanation: ' || text",
            "'This query is explained first.' || chr(10) || text",
            "'The result' || chr(10) || text || chr(10) || 'Note: done'",
            "'SELECT x' || chr(13) || chr(10) || 'FROM y;' || chr(10) || '-- ' || text",
            "'  ' || chr(10) || ' '",
        )
    )
)
EXTRACTED = f"""WITH made AS (SELECT doc_id query_id, CASE doc_id % 8 {WRAPPED} END response FROM documents),
bare AS (SELECT query_id, regexp_replace(regexp_replace(response, '```sql\\s*', '', 'g'),
    '```\\s*', '', 'g') t FROM made),
found AS (SELECT query_id, t, regexp_extract(t, '(?is){STATEMENT}.*') hit,
    regexp_extract(t, '(?is){STATEMENT}') head FROM bare),
parts AS (SELECT query_id, t, head, substr(hit, length(head) + 1) tail,
    list_transform(string_split(trim(t, {SPACES}), chr(10)), lambda l: trim(l, {SPACES})) lines FROM found),
cut AS (SELECT *, list_position(list_transform(lines,
    lambda l: regexp_matches(l, '{EXPLAINS}')), true) stop FROM parts),
kept AS (SELECT *, array_to_string(list_filter(CASE WHEN stop > 0 THEN lines[1:stop - 1] ELSE lines END,
    lambda l: l <> ''), chr(10)) before FROM cut),
chosen AS (SELECT query_id, CASE WHEN head <> ''
    THEN trim(head || regexp_split_to_array(tail, '{STATEMENT_END}')[1], {SPACES})
    WHEN before <> '' THEN before ELSE trim(t, {SPACES}) END sql FROM kept)
SELECT query_id, trim(rtrim(sql, ';'), {SPACES}) sql FROM chosen"""

# Statements: what fails and what differs by type is stated, the rest is run.

FAILS = {"unknown_column", "unknown_table", "bad_cast", "write", "absent"}
DIFFERS = {"text_keys", "more_columns"}
REGIONS = range(5)


def _pairs():
    """``(pair id, gold, generated, gold runs, generated runs, name)``."""
    for name, (gold, made) in REGION_PAIRS.items():
        for r in REGIONS:
            filled = (text.replace("{r}", str(r)) for text in (gold, made))
            yield f"{name}_{r}", *filled, True, True, name
    for name, (gold, made) in PLAIN_PAIRS.items():
        yield name, gold, made, name != "bad_gold", name not in FAILS, name


def _bare(sql: str) -> str:
    return sql.rstrip(";")


def _equal(gold: str, made: str, name: str) -> str:
    if name in DIFFERS:
        return "false"
    gold, made = f"(FROM ({_bare(gold)}))", f"(FROM ({_bare(made)}))"
    return (
        f"NOT EXISTS (FROM ({gold} EXCEPT {made})) AND NOT EXISTS (FROM ({made} EXCEPT {gold}))"
    )


def _union(rows) -> str:
    return "\nUNION ALL ".join(rows)


def _run_statements() -> str:
    ran = {}
    for _, gold, made, gold_ok, made_ok, _ in _pairs():
        ran[gold], ran[made] = gold_ok, made_ok
    return _union(
        f"SELECT 'tpch' db_id, {_text(sql) if sql else 'NULL::VARCHAR'} sql, {str(ok).lower()} success, "
        + (f"(SELECT count(*) FROM (SELECT DISTINCT * FROM ({_bare(sql)})))" if ok else "NULL::BIGINT")
        + " n_rows"
        for sql, ok in ran.items()
    )


def _match(gold, made, gold_ok, made_ok, name) -> str:
    return _equal(gold, made, name) if gold_ok and made_ok else "false"


def _execution_match() -> str:
    return _union(
        f"SELECT {_text(pair_id)} pair_id, {_match(gold, made, gold_ok, made_ok, name)} execution_match, "
        f"{str(gold_ok).lower()} gold_success, {str(made_ok).lower()} gen_success"
        for pair_id, gold, made, gold_ok, made_ok, name in _pairs()
    )


def _wins(a: str, b: str) -> str:
    a_only = f"count(*) FILTER ({a} AND NOT {b})"
    b_only = f"count(*) FILTER ({b} AND NOT {a})"
    return (
        f"SELECT '{a}' method_a, '{b}' method_b, {a_only} a_only, {b_only} b_only, "
        f"CASE WHEN {a_only} > {b_only} THEN '{a}' WHEN {a_only} < {b_only} THEN '{b}' ELSE 'tie' END "
        f"winner, abs({a_only} - {b_only}) margin FROM outcomes"
    )


def _first_three(n_right: int) -> str:
    return _with(
        OUTCOMES,
        f"picked AS (SELECT idx, question, db_id FROM outcomes WHERE {RIGHT} = {n_right})",
        select="SELECT *, (SELECT count(*) FROM picked) total FROM picked ORDER BY idx LIMIT 3",
    )


ORACLES = {
    "list_databases": _with(PARTS, select="SELECT DISTINCT db_id FROM parts"),
    "catalog_missing_ids": _with(
        PARTS,
        select="""SELECT DISTINCT 'db' || (o_custkey // 12) db_id FROM orders
        WHERE 'db' || (o_custkey // 12) NOT IN (SELECT db_id FROM parts)""",
    ),
    "catalog_columns": _with(
        PARTS,
        select="""SELECT db_id, pos + 1 col_idx, pos // 5 table_idx, 'table_' || (pos // 5) "table",
        name "column", type FROM parts""",
    ),
    "catalog_foreign_keys": _with(PARTS, select="SELECT * FROM fks"),
    "catalog_primary_keys": _with(PARTS, select="SELECT * FROM pks"),
    "schema_text": _with(SCHEMAS, select="SELECT db_id, schema_text FROM schemas"),
    "retrieval_corpus": _with(
        EXAMPLES,
        SCHEMAS,
        select="""SELECT 'example' "type", idx, db_id, question, query, schema_text "schema",
        question || chr(10) || chr(10) || 'Database: ' || db_id "text"
        FROM examples JOIN schemas USING (db_id) WHERE split = 'train'
        UNION ALL SELECT 'schema', NULL, db_id, NULL, NULL, schema_text,
        'Database: ' || db_id || chr(10) || schema_text FROM schemas""",
    ),
    "examples_by_database": _with(
        EXAMPLES, select="SELECT * FROM examples WHERE split = 'dev' AND db_id = 'db0'"
    ),
    "index_corpus": _with(
        EXAMPLES,
        select="""SELECT idx item_id, idx corpus_idx, 'example' "type", db_id, question, query,
        question "text" FROM examples""",
    ),
    "first_n_examples": _with(EXAMPLES, select="SELECT * FROM examples ORDER BY idx LIMIT 100"),
    "db_counts": _with(
        EXAMPLES,
        select="SELECT split, db_id, count(*) n, min(idx) first_idx FROM examples GROUP BY ALL",
    ),
    "top_databases": _with(
        EXAMPLES,
        select="""SELECT split, db_id, count(*) n, min(idx) first_idx FROM examples
        WHERE split = 'train' GROUP BY ALL ORDER BY n DESC, first_idx LIMIT 10""",
    ),
    "dataset_summary": _with(
        EXAMPLES,
        PARTS,
        select="""SELECT split part, count(*) n_rows, count(DISTINCT db_id) n_databases FROM examples
        GROUP BY split UNION ALL SELECT 'catalog', count(DISTINCT db_id), count(DISTINCT db_id)
        FROM parts""",
    ),
    "token_counts": _with(CORPUS, BM25, select="SELECT item_id, term, tf FROM tf"),
    "bm25_index_stats": _with(
        CORPUS,
        BM25,
        select="""SELECT n n_docs, n_tokens::BIGINT n_tokens, (SELECT count(*) FROM df) n_terms,
        round(avgdl, 6) avgdl, (SELECT round(avg(idf0), 6) FROM df) avg_idf FROM st""",
    ),
    "bm25_idf": _with(CORPUS, BM25, select="SELECT term, df, round(idf, 6) idf FROM idf"),
    "bm25_topk": _bm25_topk(within=False, fill=False),
    "bm25_topk_in_db": _bm25_topk(within=True, fill=False),
    "bm25_topk_filled": _bm25_topk(within=True, fill=True),
    "bm25_topk_postings": _bm25_topk(within=False, fill=False),
    "bm25_topk_in_db_postings": _bm25_topk(within=True, fill=False),
    "bm25_topk_global_filled_postings": _bm25_topk(within=False, fill=True),
    "bm25_topk_filled_postings": _bm25_topk(within=True, fill=True),
    "hashed_embeddings": _with(
        CORPUS, _places("places", "item_id", "corpus"), select="SELECT * FROM places"
    ),
    "vector_norms": """SELECT vec_id,
        round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) norm,
        1.0::DOUBLE unit_norm FROM embeddings""",
    "vector_distance": _label_hits(
        "SELECT item_id vec_id, round(distance, 6) distance FROM near WHERE query_id = label"
    ),
    "vector_index_roundtrip": """SELECT vec_id item_id, label::VARCHAR db_id, 1.0::DOUBLE norm
        FROM embeddings""",
    "bm25_topk_global_filled": _bm25_topk(within=False, fill=True),
    "vector_index_values": """SELECT item_id, pos - 1 place, round(CASE WHEN item_id % 50 = 0 THEN 0 ELSE x / norm END, 6) x
        FROM (SELECT vec_id item_id, unnest(embedding::DOUBLE[]) x, generate_subscripts(embedding, 1) pos,
            sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) norm FROM embeddings)""",
    "generated_by_function": _with(
        TURNS, select=f"SELECT idx query_id, 'SELECT ' || length({_prompt(PLAIN_TEMPLATE)}) response FROM turns"
    ),
    "questions_to_accuracy": _with(
        CONTEXTS,
        select="SELECT method, count(*) FILTER (ok) correct, count(*) total, round(count(*) FILTER (ok) / count(*), 6) accuracy FROM ("
        + _union(
            f"SELECT '{method}' AS method, length({prompt}) % 7 = length(question) % 7 ok FROM queries "
            "LEFT JOIN schemas USING (db_id) LEFT JOIN bm25_text b USING (query_id)"
            for method, prompt in METHOD_PROMPTS.items()
            if method in ("baseline", "schema_only", "bm25_rag")
        )
        + ") GROUP BY method",
    ),
    "read_examples": _with(EXAMPLES, select="SELECT 'all' split, idx, db_id, question, query FROM examples"),
    "read_catalog": _with(SCHEMAS, select="SELECT db_id, schema_text FROM schemas"),
    "registered_database": """SELECT n_name, count(*) n FROM nation JOIN customer ON c_nationkey = n_nationkey
        GROUP BY n_name""",
    "method_results_roundtrip": _with(OUTCOMES, select="SELECT method, idx, execution_match FROM results"),
    "read_method_documents": _with(
        OUTCOMES, select="SELECT method, idx, question, db_id, execution_match FROM results"
    ),
    "analysis_document": _with(
        OUTCOMES,
        select=f"SELECT count(*) num_examples, count(*) FILTER ({RIGHT} = 0) all_failed, "
        f"count(*) FILTER ({RIGHT} = {len(METHODS)}) all_succeeded, "
        + ", ".join(f"round(count(*) FILTER ({m}) / count(*), 6) accuracy_{m}" for m in METHODS)
        + ", "
        + ", ".join(f"count(*) FILTER ({m} AND {RIGHT} = 1) only_{m}" for m in METHODS)
        + " FROM outcomes",
    ),
    "coverage_gaps": _with(
        OUTCOMES,
        select="""SELECT idx, 6 - (idx % 7 = 0)::BIGINT - (idx % 11 = 0)::BIGINT n_methods FROM outcomes
        WHERE idx % 7 = 0 OR idx % 11 = 0""",
    ),
    "experiment_summary": _with(
        ACCURACY,
        select=f"""SELECT total num_examples, {K}::BIGINT k_value, method best_method,
        round(accuracy.accuracy, 6) best_accuracy FROM accuracy
        ORDER BY accuracy.accuracy DESC, list_position({list(METHODS)}, method) LIMIT 1""",
    ),
    "sweep_summary": _with(
        K_ACCURACY,
        select="""SELECT total num_examples, k best_k, round(accuracy, 6) best_accuracy FROM k_accuracy
        ORDER BY k_accuracy.accuracy DESC, k LIMIT 1""",
    ),
    "reported_pairs": _with(OUTCOMES, select=_union(_wins(a, b) for a, b in REPORTED_PAIRS)),
    "vector_topk": _label_hits(
        f"SELECT query_id, near rank, item_id, {HIT} FROM near WHERE near <= {K}"
    ),
    "vector_topk_postfilter": _label_hits(
        f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY near) rank, item_id, {HIT}
        FROM near WHERE near <= {5 * K} AND label = {OWN_LABEL} QUALIFY rank <= {K}"""
    ),
    "vector_topk_prefilter": _label_hits(
        f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY near) rank, item_id, {HIT}
        FROM near WHERE label = {OWN_LABEL} QUALIFY rank <= {K}"""
    ),
    "vector_topk_sweep": _label_hits(
        f"""SELECT k::BIGINT k, query_id,
        row_number() OVER (PARTITION BY k, query_id ORDER BY near) rank, item_id, {HIT}
        FROM near, range({KS[0]}, {KS[-1] + 5}, 5) r(k) WHERE near <= 5 * k AND label = {OWN_LABEL}
        QUALIFY rank <= k"""
    ),
    "text_vector_topk": _with(
        CORPUS,
        QUERIES,
        TEXT_DISTANCES,
        select=f"SELECT query_id, rank, item_id, {HIT} FROM dense_hits",
    ),
    "rag_context": _with(CONTEXTS, select="SELECT query_id, db_id, context FROM contexts"),
    "prompt_plain": _with(
        TURNS, select=f"SELECT idx query_id, {_prompt(PLAIN_TEMPLATE)} prompt FROM turns"
    ),
    "prompt_rag": _with(
        CONTEXTS, select=f"SELECT query_id, {_prompt(RAG_TEMPLATE)} prompt FROM contexts"
    ),
    "prompt_stepwise": _with(
        CONTEXTS, select=f"SELECT query_id, {_prompt(STEPWISE_TEMPLATE)} prompt FROM contexts"
    ),
    "prompts_by_method": _with(
        CONTEXTS,
        TEXT_DISTANCES,
        _example_text("dense_text", "dense_hits"),
        select=_union(
            f"SELECT query_id, '{method}' AS method, {prompt} AS prompt {PROMPT_JOINS}"
            for method, prompt in METHOD_PROMPTS.items()
        ),
    ),
    "responses_join": _with(
        TURNS,
        select="""SELECT idx query_id, query response FROM turns
        LEFT JOIN answers USING (conv_id, turn)""",
    ),
    "extract_sql": EXTRACTED,
    "run_statements": _run_statements(),
    "results_equal": _union(
        f"SELECT {_text(pair_id)} pair_id, {_equal(gold, made, name)} equal"
        for pair_id, gold, made, gold_ok, made_ok, name in _pairs()
        if gold_ok and made_ok
    ),
    "execution_match": _execution_match(),
    "evaluate_methods": f"""SELECT method, count(*) FILTER (ok) correct, count(*) total,
        round(count(*) FILTER (ok) / count(*), 6) accuracy FROM (
        SELECT 'written' AS method, execution_match ok FROM ({_execution_match()}) UNION ALL
        SELECT 'copied', gold_success FROM ({_execution_match()})) GROUP BY method""",
    "method_accuracy": _with(
        ACCURACY, select="SELECT method, correct, total, round(accuracy, 6) accuracy FROM accuracy"
    ),
    "accuracy_vs_baseline": _with(
        ACCURACY,
        select="""SELECT method, correct, total, round(accuracy, 6) accuracy,
        CASE WHEN method <> 'baseline' THEN round(accuracy -
            (SELECT accuracy FROM accuracy WHERE method = 'baseline'), 6) END improvement
        FROM accuracy""",
    ),
    "best_method": _with(
        ACCURACY,
        select=f"""SELECT method, correct, total, round(accuracy, 6) accuracy FROM accuracy
        ORDER BY accuracy.accuracy DESC, list_position({list(METHODS)}, method) LIMIT 1""",
    ),
    "accuracy_by_k": _with(
        K_ACCURACY, select="SELECT k, correct, total, round(accuracy, 6) accuracy FROM k_accuracy"
    ),
    "best_k": _with(
        K_ACCURACY,
        select="""SELECT k, correct, total, round(accuracy, 6) accuracy FROM k_accuracy
        ORDER BY k_accuracy.accuracy DESC, k LIMIT 1""",
    ),
    "method_alignment": _with(OUTCOMES, select="SELECT * EXCLUDE (n_chars) FROM outcomes"),
    "unique_successes": _with(
        OUTCOMES,
        select=_union(
            f"""SELECT '{m}' AS method, count(*) n, min(idx) first_idx, arg_min(question, idx) question,
            arg_min(db_id, idx) db_id FROM outcomes WHERE {m} AND {RIGHT} = 1"""
            for m in METHODS
        ),
    ),
    "all_failed": _first_three(0),
    "all_succeeded": _first_three(len(METHODS)),
    "pairwise_methods": _with(
        OUTCOMES,
        select=_union(
            _wins(a, b) for i, a in enumerate(METHODS) for b in METHODS[i + 1 :]
        ),
    ),
    "method_agreement": _with(
        OUTCOMES,
        select=f"""SELECT count(*) FILTER ({RIGHT} IN (0, {len(METHODS)})) agree, count(*) total,
        round(count(*) FILTER ({RIGHT} IN (0, {len(METHODS)})) / count(*), 6) rate FROM outcomes""",
    ),
}
