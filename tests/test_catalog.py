import json

import pytest

from querent.operators import corpus, metrics, schema
from querent.sources.catalogs import last_by_database, read_catalog
from querent.sources.examples import read_examples

SHOP = {
    "db_id": "shop",
    "table_names_original": ["item", "sale", "empty"],
    "column_names_original": [[-1, "*"], [0, "id"], [0, "name"], [1, "id"], [1, "item_id"]],
    "column_types": ["text", "number", "text", "number", "number"],
    "foreign_keys": [[4, 1]],
    "primary_keys": [1, 3],
}
PLAIN = {
    "db_id": "plain",
    "table_names_original": ["only"],
    "column_names_original": [[-1, "*"], [0, "x"]],
    "column_types": ["text", "number"],
}
OLD_SHOP = dict(SHOP, table_names_original=["old", "older", "oldest"])
EXAMPLES = [
    {"db_id": "shop", "question": "How many?", "query": "SELECT count(*) FROM item"},
    {"db_id": "plain", "question": "Which x?\nAll", "query": "SELECT x FROM only", "extra": 1},
    {"db_id": "shop", "question": "Größe?", "query": "SELECT name FROM item"},
]
SHOP_TEXT = (
    "Database: shop\n\nTables and Columns:\n"
    "\nitem:\n  - id (number)\n  - name (text)\n"
    "\nsale:\n  - id (number)\n  - item_id (number)\n"
    "\nempty:\n"
    "\nForeign Keys:\n  - sale.item_id -> item.id\n"
    "\nPrimary Keys:\n  - item.id\n  - sale.id\n"
)
PLAIN_TEXT = "Database: plain\n\nTables and Columns:\n\nonly:\n  - x (number)\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("json")
    (folder / "tables.json").write_text(json.dumps([OLD_SHOP, PLAIN, SHOP], indent=1))
    (folder / "train.json").write_text(json.dumps(EXAMPLES, ensure_ascii=False, indent=1), "utf-8")
    lines = [json.dumps(dict(e, idx=i * 10)) for i, e in enumerate(EXAMPLES)]
    (folder / "dev.jsonl").write_text("\n".join(lines))
    return folder


@pytest.fixture(scope="module")
def catalog(spark, files):
    return read_catalog(spark, str(files / "tables.json"))


@pytest.fixture(scope="module")
def examples(spark, files):
    train = read_examples(spark, str(files / "train.json"), "train")
    return train.union(read_examples(spark, str(files / "dev.jsonl"), "dev", layout="lines"))


def test_examples_keep_their_position(examples):
    rows = examples.orderBy("split", "idx").collect()
    assert [(r.split, r.idx) for r in rows] == [
        ("dev", 0), ("dev", 10), ("dev", 20), ("train", 0), ("train", 1), ("train", 2),
    ]
    assert rows[-1].question == "Größe?"


def test_missing_input_is_found_before_any_work(spark, files):
    with pytest.raises(FileNotFoundError):
        read_examples(spark, str(files / "none.json"), "train")


def test_last_duplicate_of_a_database_wins(catalog):
    rows = {r.db_id: r for r in catalog.collect()}
    assert set(rows) == {"shop", "plain"}
    assert rows["shop"].table_names_original == ["item", "sale", "empty"]
    assert rows["plain"].foreign_keys is None


def test_last_by_database_on_a_hot_database(spark):
    rows = spark.range(1000).selectExpr("'hot' AS db_id", "id AS ord", "id * 2 AS v")
    assert last_by_database(rows).collect()[0].v == 1998


def test_columns_and_keys(catalog):
    columns = schema.flatten_columns(catalog).filter("db_id = 'shop'").orderBy("col_idx").collect()
    assert [tuple(r)[1:] for r in columns] == [
        (1, 0, "item", "id", "number"),
        (2, 0, "item", "name", "text"),
        (3, 1, "sale", "id", "number"),
        (4, 1, "sale", "item_id", "number"),
    ]
    assert [tuple(r) for r in schema.resolve_foreign_keys(catalog).collect()] == [
        ("shop", 0, "sale", "item_id", "item", "id")
    ]
    keys = schema.resolve_primary_keys(catalog).orderBy("pk_ord").collect()
    assert [tuple(r) for r in keys] == [("shop", 0, "item", "id"), ("shop", 1, "sale", "id")]


def test_schema_text_is_exact_and_needs_no_shuffle(catalog, spark):
    text = schema.render_schema_text(catalog)
    assert {r.db_id: r.schema_text for r in text.collect()} == {
        "shop": SHOP_TEXT, "plain": PLAIN_TEXT,
    }
    stored = spark.createDataFrame(catalog.collect(), catalog.schema)
    plan = schema.render_schema_text(stored)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_unknown_databases_are_named(catalog, spark):
    wanted = spark.createDataFrame([("shop",), ("ghost",), ("ghost",)], "db_id string")
    assert [r.db_id for r in schema.missing_databases(catalog, wanted).collect()] == ["ghost"]
    with pytest.raises(ValueError, match="ghost"):
        schema.schema_of(catalog, wanted)
    known = schema.schema_of(catalog, wanted.filter("db_id = 'shop'"))
    assert [r.db_id for r in known.collect()] == ["shop"]
    assert sorted(r.db_id for r in schema.list_databases(catalog).collect()) == ["plain", "shop"]


def test_example_lookups(examples):
    assert corpus.examples_for_split(examples, "train").count() == 3
    assert corpus.examples_by_database(examples, "shop").count() == 2
    assert [r.idx for r in corpus.examples_by_database(examples, "plain", "test").collect()] == [10]
    train = corpus.examples_for_split(examples, "train")
    assert [r.idx for r in corpus.take_first(train, 2).collect()] == [0, 1]
    assert corpus.take_first(train, None).count() == corpus.take_first(train, 0).count() == 3


def test_corpora(examples, catalog, spark):
    items = corpus.build_index_corpus(examples)
    assert items.columns == ["item_id", "corpus_idx", "type", "db_id", "question", "query", "text"]
    assert "text" not in corpus.drop_index_text(items).columns
    made = corpus.build_retrieval_corpus(examples, catalog).collect()
    assert sorted(r.type for r in made) == ["example"] * 3 + ["schema"] * 2
    item = next(r for r in made if r.question == "How many?")
    assert (item.text, item.schema) == ("How many?\n\nDatabase: shop", SHOP_TEXT)
    only = next(r for r in made if r.type == "schema" and r.db_id == "plain")
    assert (only.text, only.question) == (f"Database: plain\n{PLAIN_TEXT}", None)
    stray = spark.createDataFrame([("train", 9, "ghost", "q", "s")], examples.schema)
    with pytest.raises(ValueError, match="ghost"):
        corpus.build_retrieval_corpus(examples.union(stray), catalog)


def test_counts(examples, catalog):
    top = metrics.top_databases(examples).collect()
    assert [(r.db_id, r.n, r.first_idx) for r in top] == [("shop", 2, 0), ("plain", 1, 1)]
    summary = {r.part: tuple(r)[1:] for r in metrics.dataset_summary(examples, catalog).collect()}
    assert summary == {"train": (3, 2), "dev": (3, 2), "catalog": (2, 2)}


def test_catalog_lines_are_ordered_by_their_column(spark, tmp_path):
    rows = [dict(SHOP, ord=7), dict(OLD_SHOP, ord=3), dict(PLAIN, ord=1)]
    (tmp_path / "tables.jsonl").write_text("\n".join(json.dumps(row) for row in rows))
    catalog = read_catalog(spark, str(tmp_path / "tables.jsonl"), layout="lines")
    texts = {r.db_id: r.schema_text for r in schema.render_schema_text(catalog).collect()}
    assert texts == {"shop": SHOP_TEXT, "plain": PLAIN_TEXT}


@pytest.mark.parametrize("text", ['[{"db_id": "a", "question": "q", "que', '[{"db_id": "a", "question": "q"}]', "{broken"])
@pytest.mark.parametrize("layout", ["array", "lines"])
def test_broken_examples_are_errors(spark, tmp_path, text, layout):
    from querent.sources.examples import read_examples

    path = tmp_path / "examples.json"
    path.write_text(text if layout == "array" else text.strip("[]"))
    with pytest.raises(Exception):
        read_examples(spark, str(path), "train", layout=layout).collect()


@pytest.mark.parametrize("layout", ["array", "lines"])
@pytest.mark.parametrize(
    "row",
    [
        '{"db_id": "a", "table_names_original": ["t"], "column_names_original": [["0", "c"]]',
        '{"db_id": "a", "table_names_original": ["t"], "column_names_original": [["0", "c"]], "ord": 1}',
        '{"db_id": "a", "table_names_original": ["t"], "column_names_original": [["0", "c"]], "column_types": [], "ord": 1}',
    ],
)
def test_broken_catalogs_are_errors(spark, tmp_path, row, layout):
    from querent.sources.catalogs import read_catalog

    path = tmp_path / "catalog.json"
    path.write_text(f"[{row}]" if layout == "array" else row)
    with pytest.raises(Exception):
        read_catalog(spark, str(path), layout=layout).collect()


@pytest.mark.parametrize("keys", ["array(array(1L, 9L))", "array(array(1L))", "array(array(0L, 1L))"])
def test_bad_keys_are_errors(spark, keys):
    row = spark.sql(
        f"""SELECT 'a' db_id, array('t') table_names_original, array(array('-1', '*'), array('0', 'c')) column_names_original,
        array('text', 'int') column_types, {keys} foreign_keys, array(1L) primary_keys"""
    )
    with pytest.raises(Exception, match="database a"):
        schema.render_schema_text(row).collect()
    bad = row.selectExpr("* EXCEPT (foreign_keys, primary_keys)", "array(5L) AS primary_keys", "CAST(NULL AS array<array<bigint>>) AS foreign_keys")
    for made in (schema.resolve_primary_keys(bad), schema.render_schema_text(bad)):
        with pytest.raises(Exception, match="database a"):
            made.collect()
