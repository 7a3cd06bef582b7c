"""Every outcome that a rule can have is met on the driver tables, so that no agreement is empty."""
import glob
import os

import duckdb
import pytest

from cantata.plans import domain

DATA = "/root/testdata/sf0.01"
OUTCOMES = {
    ("clock_map", "status"): "ok before_start stale_epoch unanchored", ("clock_epochs", "coalesce(reason, 'none')"): "none device_error counter_reset capture_gap playback_transition",
    ("threshold_check", "status"): "pass fail unverified not_listed threshold_differs direction_differs", ("dependency_shape", "status"): "ok stale incomplete", ("key_uniqueness", "fault"): "missing blank twice",
    ("idempotent_import", "outcome"): "publish reuse conflict", ("edit_diff", "op"): "add_lyric update_lyric add_note update_note delete_note delete_lyric", ("probe_json", "status"): "ok no_stream sample_rate channels duration_ts",
    ("drift_slope", "outcome"): "ok non_monotonic out_of_range", ("artifact_paths", "status"): "ok too_long forbidden_character not_normalized", ("plan_exact", "split_part(status, ':', 1)"): "ok model_plan_missing model_plan_fallback",
    ("runtime_manifest", "status"): "ok schema text sha256 zero_size duplicate", ("stage_provenance", "status"): "ok audio_missing audio_mismatch incomplete inconsistent", ("asset_checks", "status"): "ok not_owned destination_twice digest_or_size too_large inconsistent",
    ("cents_between", "status"): "ok not_positive", ("boundary_decision", "reason"): "strong_boundary silence_or_breath sustained_pitch_change external_transition expressive_motion_suppressed",
}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name, column", sorted(OUTCOMES))
def test_outcomes(duck, name, column):
    got = {r[0] for r in duck.execute(f"select distinct {column} from ({domain.oracle_sql()[name]}) q").fetchall()}
    assert got == set(OUTCOMES[name, column].split())
