"""Pages as a sink: all or none."""

import json

import pytest
from pyspark.sql import functions as F

from corroba.functions.values import MANAGED
from corroba.sources import pages
from corroba.sources.pages import place_below, save_pages

MARK = MANAGED[0]


def rows(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "/") + ".md", v) for k, v in texts.items()], "path string, page string").repartition(3)


def held(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file() and p.name != pages.LEDGER}


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_pages_and_their_index(spark, tmp_path, scheme):
    save_pages(rows(spark, a="# Alpha\n\nx", b__c=f"é {MARK}", empty=None), f"{scheme}{tmp_path}", title="All")
    found = held(tmp_path)
    assert {k: v for k, v in found.items() if k != "README.md"} == {"a.md": "# Alpha\n\nx", "b/c.md": f"é {MARK}", "empty.md": ""}
    assert found["README.md"] == f"# All\n\n<!-- {MARK} -->\n\n- [Alpha](a.md)\n- [c](b/c.md)\n- [empty](empty.md)\n"
    assert set(json.loads((tmp_path / pages.LEDGER).read_text())) == {"a.md", "b/c.md", "empty.md"}


def test_stale_pages_go_and_authored_ones_stay(spark, tmp_path):
    (tmp_path / "mine.md").write_text("by hand")
    save_pages(rows(spark, a=MARK, b=MARK, c=MARK, mine=MARK), str(tmp_path))
    assert held(tmp_path)["mine.md"] == "by hand"
    (tmp_path / "b.md").write_text("taken over by hand")
    save_pages(rows(spark, a=f"{MARK} new"), str(tmp_path))
    found = held(tmp_path)
    assert found["a.md"] == f"{MARK} new" and found["b.md"] == "taken over by hand" and "c.md" not in found and found["mine.md"] == "by hand"
    assert "(a.md)" in found["README.md"] and "b.md" not in found["README.md"]


def test_appending_removes_nothing(spark, tmp_path):
    save_pages(rows(spark, a=MARK), str(tmp_path))
    save_pages(rows(spark, b=MARK), str(tmp_path), overwrite=False)
    found = held(tmp_path)
    assert set(found) == {"a.md", "b.md", "README.md"} and "(a.md)" in found["README.md"] and "(b.md)" in found["README.md"]


def test_an_authored_index_stays(spark, tmp_path):
    (tmp_path / "README.md").write_text("my own index")
    save_pages(rows(spark, a=MARK), str(tmp_path))
    assert held(tmp_path)["README.md"] == "my own index"


def test_a_failed_job_leaves_the_old_pages(spark, tmp_path):
    save_pages(rows(spark, a=f"{MARK} old", b=f"{MARK} old"), str(tmp_path))
    before = held(tmp_path)
    failing = rows(spark, a=f"{MARK} new", b=f"{MARK} new", c=MARK).withColumn("page", F.when(F.col("path") == "c.md", F.raise_error(F.lit("no page"))).otherwise(F.col("page")))
    with pytest.raises(Exception, match="no page"):
        save_pages(failing, str(tmp_path))
    assert held(tmp_path) == before and not list(tmp_path.glob(".pages-*"))


def test_pages_lie_below_the_folder(spark, tmp_path):
    assert place_below("./a//b.md") == "a/b.md"
    for path in ("", "../x.md", "a/../../x.md", ".pages.json", "/.."):
        with pytest.raises(ValueError):
            place_below(path)
    with pytest.raises(Exception, match="no page below"):
        save_pages(spark.createDataFrame([("../x.md", "x")], "path string, page string"), str(tmp_path / "in"))
    assert not (tmp_path / "x.md").exists()


def test_no_pages(spark, tmp_path):
    save_pages(spark.createDataFrame([], "path string, page string"), str(tmp_path))
    assert set(held(tmp_path)) == {"README.md"}
