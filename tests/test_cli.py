import os
import subprocess
import sys
import tempfile

from conftest import ROOT

from cadence.sources.files import write_csv, write_parquet
from cadence.sources.generate import generate_interactions, generate_metadata


def test_cli_runs_jobs_on_reference_schema_tables(spark):
    base = tempfile.mkdtemp(prefix="cadence-cli-")
    ev_path, md_path = os.path.join(base, "ui"), os.path.join(base, "um")
    write_parquet(generate_interactions(spark, 3000, seed=1).drop("id"), ev_path, ["date"])
    write_parquet(generate_metadata(spark, 300, seed=2).drop("id"), md_path, ["country"])
    env = dict(os.environ, PYTHONPATH=ROOT)
    listed = subprocess.run([sys.executable, "-m", "cadence", "--list"], env=env, capture_output=True, text=True, check=True)
    assert "session_metrics" in listed.stdout.split()
    out = os.path.join(base, "out")
    subprocess.run(
        [sys.executable, "-m", "cadence", "activity_by_country_subscription", "--interactions", ev_path,
         "--metadata", md_path, "--out", out, "--master", "local[2]"],
        env=env, capture_output=True, text=True, check=True, timeout=600,
    )
    res = spark.read.parquet(out)
    assert set(res.columns) == {"country", "subscription_type", "count"} and res.count() > 0


def test_cli_covers_generation_conversion_and_quality(spark, capsys):
    from cadence.__main__ import _jobs, main

    base = tempfile.mkdtemp(prefix="cadence-cli-")
    ev, md = os.path.join(base, "ui"), os.path.join(base, "um")
    write_parquet(generate_interactions(spark, 400, seed=1).drop("id"), ev, ["date"])
    write_parquet(generate_metadata(spark, 50, seed=2).drop("id"), md, ["country"])
    for job in sorted(_jobs()):
        out = os.path.join(base, "out", job)
        args = [job, "--interactions", ev, "--metadata", md, "--out", out, "--rows", "300", "--path", os.path.join(base, "side", job)]
        if job == "convert":
            csv = os.path.join(base, "csv")
            write_csv(spark.read.parquet(ev), csv, ["date"])
            args[2] = csv
        assert main(args) == 0
        assert spark.read.parquet(out).count() >= 0
    back = spark.read.parquet(os.path.join(base, "out", "convert"))
    assert back.count() == 400 and back.where("timestamp IS NULL").count() == 0
    some = ["active_users", "--interactions", ev, "--grain", "quarter", "--actions", "edit", "create", "--show", "5"]
    assert main(some) == 0 and "active_users" in capsys.readouterr().out
