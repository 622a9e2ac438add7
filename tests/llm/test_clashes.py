"""Extra columns named like inner ones change nothing."""

from colloquy.llm import forest, spans

LINES = ["One two three four five six seven.", "Alpha beta gamma delta epsilon zeta.", "Red green blue black white grey pink."]


def test_inner_names_as_extra_columns(spark):
    text = " ".join(LINES)
    names = ["gone", "stays", "key", "h", "at", "first", "last", "id", "grp", "set", "rows", "label", "starts"]
    rows = [(1, text, *["x"] * len(names)), (2, "Other words before it all. " + text, *["y"] * len(names)), (3, None, *["z"] * len(names)),
            (4, text, *["w"] * len(names))]
    frame = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = {r["doc_id"]: r for r in spans.remove_repeats(frame).collect()}
    assert [got[1][n] for n in names] == ["x"] * len(names) and got[1]["text"] == text
    assert "Alpha" not in got[2]["text"] and got[3]["text"] is None and "Alpha" not in got[4]["text"]
    kept = {r["doc_id"]: r for r in forest.keep_one(frame).collect()}
    assert set(kept) == {1, 2, 3} and kept[2]["stays"] == "y" and sorted(kept[1].asDict()) == sorted(frame.columns)
