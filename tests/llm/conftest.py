"""Small tables that hold the awkward cases, beside the smallest of the driver's tables."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

DATA = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"passage{i}" for i in range(60))
LONG = " ".join(f"w{i * i % 7919}" for i in range(40_000))
CODE = "a b c d e f g h i j k l m n o p q r s t"

#: (doc_id, text, lang, source)
AWKWARD = [
    (900_001, None, "en", "web"),
    (900_002, "", "en", "web"),
    (900_003, " \t\n\r\x0b\x0c ", "de", None),
    (900_004, "Word", None, "web"),
    (900_005, "Two words", None, None),
    (900_006, "MiXeD case WORDS and 123 numbers, e.g. 4.5%!", "en", "web"),
    (900_007, "mixed case words and 123 numbers, e.g. 4.5%!", "en", "web"),
    (900_008, f"Start of one. {PASSAGE} end of one.", "en", "web"),
    (900_009, f"Start of two. {PASSAGE} end of two.", "en", "web"),
    (900_010, f"{PASSAGE} {PASSAGE}", "en", "books"),
    (900_011, LONG, "en", "web"),
    (900_012, LONG + " more", "en", "web"),
    (900_013, "line\nline\n\n  \nother\r\nline\n" * 30, "fr", "web"),
    (900_014, "Ünïcödé tëxt with odd​spaces ΑΒΓ абв 日本語 🙂🙂 é ǅ ß", "de", "web"),
    (900_015, "nul\x00inside and <|endoftext|> special <|startoftext|> strings \x7f\x01", "en", "web"),
    (900_016, "the same the same the same the same the same the same", "en", "web"),
    (900_017, CODE, "en", "code"),
    (900_018, CODE, "en", "code"),
    (900_019, CODE + " " + CODE, "en", "code"),
    (900_020, "x" * 50_000, "en", "web"),
    (900_021, "it's we'll they've I'm 'quoted' don't   three   spaces \n\n\n lines", "en", "web"),
    (900_022, "!!! ### $$$ %%% &&& ||| <<< >>> ***", "en", "web"),
    (900_023, "12345 67890 1 2 3", "en", "web"),
]


def documents(extra: bool = False, awkward: bool = True, base: bool = True) -> pa.Table:
    """doc_id, text, lang, source, n_chars; ``extra`` adds rows with null and repeated ids, and columns with names that operators use."""
    t = pq.read_table(f"{DATA}/documents.parquet") if base else pq.read_table(f"{DATA}/documents.parquet").slice(0, 0)
    rows = AWKWARD if awkward else []
    if extra:
        rows = [*rows, (None, f"No id. {PASSAGE}", "en", "web"), (None, None, None, None), (900_017, CODE, "en", "code"), (900_006, "another text under the same id", "en", "web")]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    more = pa.table({"doc_id": pa.array(cols[0], pa.int64()), "text": pa.array(cols[1], pa.string()), "lang": pa.array(cols[2], pa.string()), "source": pa.array(cols[3], pa.string()), "n_chars": pa.array([len(x or "") for x in cols[1]], pa.int64())})
    t = pa.concat_tables([t.select(more.column_names), more])
    if extra:
        for k, name in enumerate(["row", "block", "shard", "hash", "n", "score", "words", "bucket", "part", "page_id", "fp", "node", "component_id", "held_out", "quality", "f", "one", "spans", "items", "_part", "_text", "_quality", "_row", "_score", "open", "sequence_id", "text_hash", "my col", "a-b", "key", "count"]):
            t = t.append_column(name, pa.array([f"{k}-{i}" for i in range(len(t))]))
    return t


def write(folder, docs: pa.Table | None = None, **tables: pa.Table) -> str:
    """A folder of tables like the driver's; those that aren't given are the driver's smallest."""
    pq.write_table(documents() if docs is None else docs, f"{folder}/documents.parquet", row_group_size=100)
    for name in ("labels", "benchmark", "pages"):
        pq.write_table(tables.get(name, pq.read_table(f"{DATA}/{name}.parquet")), f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def plain(tmp_path_factory):
    """Unique ids."""
    return write(tmp_path_factory.mktemp("plain"))


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    """Null and repeated ids, and clashing columns."""
    return write(tmp_path_factory.mktemp("odd"), documents(extra=True))


@pytest.fixture(scope="session")
def bare(tmp_path_factory):
    """Tables without rows."""
    empty = {n: pq.read_table(f"{DATA}/{n}.parquet").slice(0, 0) for n in ("labels", "benchmark", "pages")}
    return write(tmp_path_factory.mktemp("bare"), documents(awkward=False, base=False), **empty)


def rows_of(folder: str, table: str = "documents") -> list[dict]:
    return pq.read_table(f"{folder}/{table}.parquet").to_pylist()
