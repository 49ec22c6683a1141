
from __future__ import annotations

import bench


def test_headline_covers_survey_baseline_set():
    ids = {name.split("_")[0] for name in bench.HEADLINE}
    assert {"R1", "R2", "R5", "R8", "R16", "W9", "W10"} <= ids
