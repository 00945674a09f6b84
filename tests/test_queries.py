"""Structure, search and scope queries on a small hand-written project."""
import pytest
from pyspark.sql import functions as F

from codeweave.operators.tables import build_index
from codeweave.plans import scope as V
from codeweave.plans import search as S
from codeweave.plans import structure as Q

BASKET = '''import decimal
from datetime import date
import csv

LIMIT = 12
CURRENCY: str = "EUR"


class Basket(Store):
    """Holds the lines."""
    owner = None

    def send_line(self, line):
        decimal.Decimal(line)
        date.today(line)

    async def process_card(self, card):
        self.send_line(card)
        csv.writer(card)


def open_basket(o):
    return Basket(o)
'''
LEDGER = '''class Ledger:
    strict = True

    def parse(self, row):
        total.match(row)
        self.book(row)

class Basket:
    def refund(self):
        pass
'''
BROKEN = "def oops(:\n"


@pytest.fixture(scope="module")
def idx(spark):
    rows = [("p", "shop/basket.py", BASKET), ("p", "util/ledger.py", LEDGER), ("p", "util/broken.py", BROKEN)]
    return build_index(spark.createDataFrame(rows, "repo string, path string, content string"),
                       persist=True)


@pytest.fixture(scope="module")
def two(spark):
    rows = [(r, p, t) for r in ("p", "q") for p, t in (("shop/basket.py", BASKET), ("util/ledger.py", LEDGER))]
    return build_index(spark.createDataFrame(rows, "repo string, path string, content string"), persist=True)


def test_answers_per_repository(two, spark):
    assert Q.functions_by_file(two, "shop/basket.py").count() == 2
    assert Q.functions_by_file(two, "shop/basket.py", "q").count() == 1
    assert {(r.repo, r.path) for r in Q.calls_of(two, "Basket.process_card").collect()} == {
        ("p", "shop/basket.py"), ("q", "shop/basket.py")}
    assert {(r.repo, r.path) for r in Q.class_detail(two, "Basket").collect()} == {
        ("p", "shop/basket.py"), ("q", "shop/basket.py")}
    many = spark.createDataFrame([("Basket.refund",), ("open_basket",), ("nothing",)], "symbol string")
    assert sorted((r.symbol, r.repo, r.path) for r in Q.calls_of(two, many).collect()) == [
        ("Basket.refund", "p", "util/ledger.py"), ("Basket.refund", "q", "util/ledger.py"),
        ("open_basket", "p", "shop/basket.py"), ("open_basket", "q", "shop/basket.py")]


def test_status_totals(idx):
    r = Q.status(idx, root="p").first()
    assert (r.total_files, r.total_classes, r.total_methods, r.total_functions,
            r.total_variables, r.error_files) == (3, 3, 4, 1, 2, 1)
    assert [x.path for x in Q.error_files(idx).collect()] == ["util/broken.py"]


def test_folder_tree_keeps_full_paths(idx):
    rows = {(r.folder, r.path) for r in Q.folder_tree(idx).collect()}
    assert ("util", "util/ledger.py") in rows and ("shop", "shop/basket.py") in rows


def test_files_without_symbols_are_kept(idx):
    imps = Q.imports_by_file(idx).where("path = 'util/ledger.py'").collect()
    assert len(imps) == 1 and imps[0].module is None
    assert Q.imports_by_file(idx, "shop/basket.py").count() == 3
    # variables drop files without any (Q8)
    paths = {r.path for r in Q.variables_by_file(idx).collect()}
    assert "util/broken.py" not in paths


def test_classes_with_counts(idx):
    r = Q.classes_by_file(idx, "shop/basket.py").first()
    assert (r.name, r.n_methods, r.n_attributes, r.bases) == ("Basket", 2, 1, ["Store"])


def test_class_detail_first_match_in_walk_order(idx):
    rows = Q.class_detail(idx, "Basket").collect()
    assert {r.path for r in rows} == {"shop/basket.py"}
    assert {r.name for r in rows if r.member_kind == "method"} == {"send_line", "process_card"}


def test_calls_of_symbol(idx):
    r = Q.calls_of(idx, "Basket.process_card").first()
    assert r.path == "shop/basket.py" and r.calls == ["self.send_line", "csv.writer"]
    # the first Basket lacks `refund`: the search continues (Q7)
    assert Q.calls_of(idx, "Basket.refund").first().path == "util/ledger.py"
    assert Q.calls_of(idx, "open_basket").first().calls == ["Basket"]
    assert Q.calls_of(idx, "Basket.missing").count() == 0
    assert Q.calls_of(idx, "Ledger.parse.x").count() == 0


def test_usages_case_insensitive_substring(idx):
    got = {(r.context, r.call) for r in Q.usages(idx, "LINE").collect()}
    assert got == {("Basket.process_card", "self.send_line")}


def test_variables_scope(idx):
    mods = {r.name for r in Q.variables_by_file(idx, scope="module").collect()}
    cls = {r.name for r in Q.variables_by_file(idx, scope="class").collect()}
    assert mods == {"LIMIT", "CURRENCY"} and cls == {"Basket.owner", "Ledger.strict"}


def test_library_usage(idx):
    rows = S.library_usage(idx, "DATE").collect()
    imp = [r for r in rows if r.type == "import"]
    assert len(imp) == 1 and imp[0].detail == ["datetime"]
    calls = [r for r in rows if r.type == "call"]
    assert [(r.symbol, r.detail) for r in calls] == [("Basket.send_line", ["date.today"])]


def test_search_substring_and_glob(idx):
    sub = {(r.type, r.name, r.category) for r in S.search(idx, "basket").collect()}
    assert ("class", "Basket", "definition") in sub
    assert ("function", "open_basket", "definition") in sub
    assert ("function", "open_basket", "usage") in sub      # calls Basket
    glob = {(r.type, r.name) for r in S.search(idx, "bask*").collect()
            if r.category == "definition"}
    assert glob == {("class", "Basket")}
    # classes [seq] only act inside a glob (a pattern with * or ?)
    assert S.search(idx, "[lL]edger").count() == 0
    assert S.search(idx, "[lL]edge?").count() == 1


def test_naming_language_vote(idx, spark):
    r = S.naming_language(idx).first()
    # words of the dictionaries: send, process, parse ... in English, none in Spanish
    assert r.dominant == "en" and r.count_es == 0 and r.count_en >= 2


def test_language_tie_goes_to_spanish(spark):
    src = "def obtener_datos():\n    pass\n\ndef get_data():\n    pass\n"
    i = build_index(spark.createDataFrame([("p", "a.py", src)], "repo string, path string, content string"))
    r = S.naming_language(i).first()
    assert (r.dominant, r.count_es, r.count_en, r.mixed_files) == ("es", 2, 2, 1)


def test_empty_index_is_undetermined(spark):
    i = build_index(spark.createDataFrame([("p", "a.md", "x")], "repo string, path string, content string"))
    assert S.naming_language(i).first().dominant == "indeterminado"
    assert Q.is_empty(i)


def test_scope_operators(idx):
    roll = {(r.folder, r.n_files) for r in V.folder_rollup(idx).collect()}
    assert (".", 3) in roll and ("util", 2) in roll
    ex = idx.files.sparkSession.createDataFrame([("p", "util")], "repo string, folder string")
    assert {r.path for r in V.visible_files(idx, ex).collect()} == {"shop/basket.py"}
    assert V.subtree_files(idx, "util").count() == 2
    labels = {r.label for r in V.import_labels(idx).collect()}
    assert labels == {"import decimal", "from datetime import date", "import csv"}
    u = V.usages_by_file(idx, "line").first()
    assert (u.path, u.n_refs, u.n_contexts) == ("shop/basket.py", 1, 1)
    sym = V.split_symbols(idx.files.sparkSession.createDataFrame([("A.b.c",), ("f",)], "symbol string"))
    assert [(r.class_part, r.member_part) for r in sym.collect()] == [("A", "b.c"), (None, "f")]


def test_suggestions_are_top_n(idx):
    assert V.suggestions(idx, "c", n=2).count() == 2
