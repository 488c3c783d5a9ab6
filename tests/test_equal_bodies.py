"""Objects with equal bodies, and statements with equal texts, are looked up once."""

import pytest

from ferryline.operators import inventory


@pytest.mark.parametrize("n", [60, 3000])
def test_what_is_written_follows_the_different_bodies(spark, monkeypatch, n):
    rows, written = {}, inventory.written

    def counted(df, *name):
        out = written(df, *name)
        rows[",".join(out.columns)] = max(rows.get(",".join(out.columns), 0), out.count())
        return out

    monkeypatch.setattr(inventory, "written", counted)
    # every third body is null; of the others, those that are equal as one line have the same place in the list
    bodies = ["create proc p as select a from wide_table where k = 1", "CREATE proc p as\n select a  from wide_table where k = 1", "create proc q as delete from other_table where z = 2"]
    objects = spark.createDataFrame([(k, f"o{k}", None if k % 3 == 0 else bodies[k // 3 % 3]) for k in range(n, 0, -1)], "ordinal long, object_name string, body string")
    texts = ["select a from wide_table where k = 1", "Select a from  wide_table\nwhere k = 1", "delete from other_table where z = 2", "delete from missing_table where z = 2", "short", None]
    statements = spark.createDataFrame([(i, texts[i % 6]) for i in range(n)], "id int, sql_text string")
    out = inventory.resolve_objects(statements, objects)
    assert out.columns == ["id", "sql_text", "object_name"]
    assert sorted((r.id, r.object_name) for r in out.collect()) == [(i, ["o1", "o1", "o7", None, None, None][i % 6]) for i in range(n)]
    assert rows["ordinal,object_name,_body,no,all"] == 2
    assert max(rows.values()) <= 100
