"""How many files the games are written to."""

import os
from pathlib import Path

import pytest

from terrace.plans import source_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are elsewhere")


def test_game_files_are_one_a_side(spark):
    path = Path(source_queries._game_folder(spark, SF).removeprefix("file://"))
    for folder in [*path.glob("tracking/game=*/team=*"), *path.glob("feed/game=*")]:
        assert len([f for f in folder.iterdir() if f.name.startswith("part-")]) == 1
