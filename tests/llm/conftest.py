import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

TYPES = {
    "documents": pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]),
    "pages": pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]),
    "benchmark": pa.schema([("item_id", pa.int64()), ("text", pa.string())]),
    "labels": pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]),
    "embeddings": pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())]),
}
#: Columns with names that the operators use themselves.
CLASHING = ("host", "kept", "score", "spans", "w", "n", "id", "row", "token", "steps", "verdict", "similarity", "mix_copy", "_id", "_spans", "_hash", "_key", "_bad_id", "_mix_source", "comp", "row_key", "held", "bad_id", "draw", "repeats", "hash")

BASE = "the quick brown fox jumps over the lazy dog while seven green birds sing about old rivers and new roads under a pale morning sky again"
ITEM = "what is the capital city of the small northern country that lies between two long rivers and a cold grey sea"
LONG = " ".join(f"word{i % 997}x{i}" for i in range(3000))
PRIVATE = "mail joe.doe@example.org or call +1 (555) 010-9999 from 10.0.0.1 or 300.1.1.1 card 4111 1111 1111 1111 and éé a@b 1.2.3.4.5.6.7.8"
CODE = "This is under the MIT License here\nand Apache  License; not the GNU General\tPublic License, mit license"
DOCS = [
    (1, BASE, "en", "web"), (2, BASE, "en", "web"), (2, BASE, "en", "web"), (3, BASE + " extra", "en", "web"), (4, None, None, None), (5, "", "en", ""), (6, "   \n\t ", "en", "web"), (None, PRIVATE, "en", "books"),
    (7, PRIVATE, "en", "web"), (8, LONG, "en", "web"), (9, "Intro words here. " + ITEM.upper() + " and more text after it", None, "code"), (10, CODE, "en", None), (11, "one two", "fr", "web"), (12, "ONE  two", "fr", "web"),
    (13, "été ☃ \U0001f600 " * 40, "fr", "web"), (14, "same line here\nsame line here\nsame line here\nother #*$ line", "en", "web"), (15, "a b c d e f g h i j k l m n " + BASE, "en", "web"), (15, ITEM, "en", "web"), (None, BASE, "en", "web"), (16, "x" * 300, "en", "web"), (17, "y" + "x" * 120, "en", "web"),
]
TABLES = {
    "documents": [(i, t, a, s, None if t is None else len(t)) for i, t, a, s in DOCS],
    "benchmark": [(1, ITEM), (2, None), (3, ""), (4, "two"), (None, ITEM + " too"), (1, ITEM)],
    "labels": [(1, 1, 0), (1, 0, 0), (2, 1, None), (5, 0, 0), (None, 1, 0), (8, None, 0), (99, 1, 1)],
    "embeddings": [
        *((i, [((i * 7919) % 101) / 50 - 1, ((i * 104729) % 97) / 40 - 1, (i % 7) / 3, ((i * i) % 31) / 10], 0) for i in range(40)), (3, [0.5, -0.25, 1.0, 2.0], 1), (None, [0.5, -0.25, 1.0, 2.0], None),
        (50, None, 0), (51, [], 0), (52, [1.0, None, 0.0, 0.0], 0), (53, [1.0, float("nan"), 0.0, 0.0], 0), (54, [1.0, float("inf"), 0.0, 0.0], 0), (55, [1.0, 2.0], 0), (56, [1.0, 2.0, 3.0, 4.0, 5.0], 0),
    ],
    "pages": [
        (1, "http://A.Example.com/en/x?q", "<html><body><nav>menu</nav><article><h1>T &amp; t</h1><p>Text   one.</p></article></body></html>" + " " * 40), (2, "http://example.com/en/", "<html><body><nav>menu</nav><article><h1>T &amp; t</h1><p>Text   one.</p></article></body></html>" + " " * 40),
        (2, "https://x.net/fr/a", "<p>hi</p>"), (3, None, None), (4, "no scheme", ""), (None, "http://ads.spam.org/p#f", "<p>hi</p>"), (5, "http://WWW.example.com/en/\n", "<div>" + "deep <b>" * 800), (6, "http://net/es/", "<p>hi</p>"),
    ],
}


def write(folder, name, rows, clash=False):
    table = pa.Table.from_pylist([dict(zip(TYPES[name].names, r)) for r in rows], TYPES[name])
    if clash:
        for c in CLASHING:
            table = table.append_column(c, pa.array([None] * len(rows), pa.string()))
    pq.write_table(table, f"{folder}/{name}.parquet")


@pytest.fixture(scope="session")
def folders(tmp_path_factory):
    """Tables of hard cases, the same with extra columns, and empty ones."""
    out = {}
    for kind in ("hard", "extra", "empty"):
        folder = out[kind] = str(tmp_path_factory.mktemp(kind))
        for name, rows in TABLES.items():
            write(folder, name, [] if kind == "empty" else rows, kind == "extra")
    return out


@pytest.fixture(scope="session")
def sql():
    def run(folder: str, text: str):
        con = duckdb.connect()
        for name in TYPES:
            con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
        found = con.execute(text)
        names = [d[0] for d in found.description]
        return sorted(names), sorted((tuple(v for _, v in sorted(zip(names, r))) for r in found.fetchall()), key=repr)

    return run
