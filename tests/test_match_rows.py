"""What the fill of two-level files sorts."""

from __future__ import annotations

from starloom.sources import text as S


def test_sorted_lines_hold_neither_paths_nor_tokens(spark, tmp_path, monkeypatch):
    path = tmp_path / "a_croco"
    path.write_text("# c\n  9 9 9 bad\n7 70 2\n  3 21 210 0.5\n  4 22 220 0.25\n\n8 80 1\n  5 23 230 1.0\n")
    seen = []
    fill = S.forward_fill
    monkeypatch.setattr(S, "forward_fill", lambda df, *a: seen.append(df) or fill(df, *a))
    rows = S.read_matches(spark, {"p": str(path)})
    assert [tuple(r) for r in rows.orderBy("cdm_halo_id").collect()] == [
        ("p", 7, 70, 21, 210, 3, 0.5), ("p", 7, 70, 22, 220, 4, 0.25), ("p", 8, 80, 23, 230, 5, 1.0),
    ]
    assert not any("array" in kind for _, kind in seen[0].dtypes) and "__path" not in seen[0].columns
    assert {r["value"] is None for r in seen[0].where("NOT __child").collect()} == {True}
