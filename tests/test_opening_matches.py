"""Openings stored twice, several candidates told apart by stops, and the fallback to all hints within the mode."""

from loomway.queries.feeds import t_opening_matches

COLS = "rec_id long, opening_id string, network string, mode string, line_2026 string, section_from string, section_to string, candidate_refs string"


def test_opening_matches(spark, tmp_path):
    rows = [
        (1, "A", "N1", "bus", "Ligne 5", "Gare", "Port", None), (2, "B", "N1", "bus", "x9", None, None, "4;5"), (3, "B", "N1", "bus", "x9", None, None, "4;5"),  # B is stored twice
        (4, "C", "N2", "bus", "7", "Mairie", "Plage", None), (5, "D", "N2", "bus", None, "Vieille Mairie", "Tour", "7"), (6, "E", "N2", "bus", None, "Lac", "Pont", "3;7"),  # two candidates, one hint
        (7, "F", "N3", "bhns", "8", "Bois", "Lac", None), (8, "G", "N3", "bus", None, "Le Bois", "Lac Nord", "1"), (9, "H", "N3", "tram", None, "Bois", "Lac", "2"), (10, "I", "N3", "bus", None, "Bois", "Tour", None),  # no name, all hints in one bus line
        (11, "J", "N4", "bus", "6", None, None, None), (12, "K", "N4", "bus", None, None, None, "6"), (13, "L", "N4", "bus", None, None, None, "6;6"),
    ]
    spark.createDataFrame(rows, COLS).write.parquet(str(tmp_path / "pt_openings_mapping.parquet"))
    got = {r.rec_id: (r.candidate, r.pos, r.how) for r in t_opening_matches(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert got[1] == (2, 2, "exact")
    assert got[4] == (5, 1, "stop-confirmed")
    assert got[7] == (8, None, "stop-confirmed")
    assert got[11] == (None, None, "ambiguous")
    assert got[2][2] == got[10][2] == "none"
