from lodeseam.llm.files import current_files


def test_files_are_put_together(spark):
    text = [f"l{i}" for i in range(1, 26)]
    part = lambda a, b: "\n".join(text[a - 1 : b])
    rows = [
        ("r", "a.py", 1, part(1, 10), "2025-01-02"), ("r", "a.py", 8, part(8, 17), "2025-01-02"), ("r", "a.py", 15, part(15, 25), "2025-01-02"),
        ("r", "a.py", 8, part(8, 17), "2025-01-02"), ("r", "a.py", 3, part(3, 5), "2025-01-02"), ("r", "a.py", 1, "old", "2025-01-01"), ("r", "b.md", 1, "x", "2025-01-01"),
        ("r", "c.py", None, "y", "2025-01-01"), (None, "d.py", 1, "z", "2025-01-01"), ("r", "e.py", 1, None, "2025-01-01"), ("r", "f.py", 1, "", "2025-01-01"), ("r", "g.py", 1, "z", None),
    ]
    df = spark.createDataFrame(rows, "repo_id string, path string, start_line int, content string, indexed_at string").selectExpr("*", "1 as n", "2 as seen", "3 as newest")
    got = {r.path: r.text for r in current_files(df).collect()}
    assert got == {"a.py": "\n".join(text), "b.md": "x", "c.py": "y", "f.py": ""}
    assert {r.path for r in current_files(df, ["md"]).collect()} == {"b.md"}
    assert current_files(df.limit(0)).count() == 0
