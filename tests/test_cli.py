import json

import pytest

from tarnflow.__main__ import main


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("cli")
    (top / "in").mkdir()
    (top / "in/river.txt").write_text("The river floods in early spring. Snow melts fast in the hills.\n\nFarmers move their cattle to high ground.")
    (top / "in/town.md").write_text("# Town\n\nThe town hall opens at nine. It closes at noon on Friday.")
    return top


def call(spark, capsys, folder, *args):
    code = main(["--data", f"file://{folder}/data", *args], spark)
    out = capsys.readouterr()
    return code, [json.loads(x) for x in out.out.splitlines() if x.startswith("{")], out.err


def test_commands(spark, capsys, folder):
    assert call(spark, capsys, folder, "list")[0] == 2
    code, rows, _ = call(spark, capsys, folder, "ingest", f"{folder}/in")
    assert code == 0 and {r["status"] for r in rows} == {"indexed"}
    assert {r["status"] for r in call(spark, capsys, folder, "ingest", f"{folder}/in")[1]} == {"skipped"}
    assert [r["status"] for r in call(spark, capsys, folder, "list")[1]] == ["current", "current"]
    assert call(spark, capsys, folder, "validate")[0] == 0
    code, rows, _ = call(spark, capsys, folder, "query", "when does the river floods in spring")
    assert code == 0 and "river" in rows[0]["text"]
    code, rows, _ = call(spark, capsys, folder, "evaluate", "when does the river floods in spring")
    assert code == 0 and rows[0]["action"] == "Correct"
    code, rows, _ = call(spark, capsys, folder, "refine", "when does the river floods in spring")
    assert code == 0 and rows and all(r["source_type"] == "internal" for r in rows)
    code, rows, _ = call(spark, capsys, folder, "run", "when does the river floods in spring")
    assert code == 0 and rows[0]["answer_status"] == "answered" and "[1]" in rows[0]["answer"]
    assert call(spark, capsys, folder, "show-run", rows[0]["run_id"])[1][0]["run_id"] == rows[0]["run_id"]
    assert call(spark, capsys, folder, "show-run", "nothing")[0] == 2
    assert call(spark, capsys, folder, "query", " ")[0] == 2


def test_web_branch(spark, capsys, folder):
    pages = f"file://{folder}/pages.parquet"
    spark.createDataFrame([("http://a.example.com/x", "<p>Zebras graze on open plains in large herds.</p><p>Other text.</p>"), ("http://localhost/x", "<p>zebras graze plains herds</p>")], "url string, html string").write.mode("overwrite").parquet(pages)
    code, rows, _ = call(spark, capsys, folder, "search-web", "zebras graze plains herds", "--pages", pages)
    assert code == 0 and {r["source_ref"] for r in rows} == {"http://a.example.com/x"}
    assert call(spark, capsys, folder, "search-web", "zebras")[0] == 2


def test_changed_sources_stop_a_search(spark, capsys, folder):
    (folder / "in/river.txt").write_text("Other words now.")
    code, _, err = call(spark, capsys, folder, "query", "river")
    assert code == 2 and "source_changed" in err
