from tillscope import jobs
from tillscope.sources import tables


def test_all_jobs(spark, raw, tmp_path, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    feed, star, out = (str(tmp_path / n) for n in ("feed", "star", "out"))
    tables.export_csv(raw, feed)
    jobs.main(["build", "--raw", feed, "--star", star, "--csv"])
    jobs.main(["profile", "--raw", feed, "--out", f"{out}/profile", "--approx"])
    jobs.main(["audit", "--star", star, "--out", f"{out}/audit"])
    jobs.main(["reports", "--star", star, "--out", f"{out}/reports"])
    jobs.main(["tests", "--star", star, "--out", f"{out}/tests"])

    loaded = tables.load_star_csv(spark, f"{star}/csv")
    stored = tables.read_star(spark, star)
    for name, df in loaded.tables().items():
        assert df.exceptAll(stored.tables()[name]).count() == 0, name
    lines = [r.value.split("\t") for r in spark.read.text(f"{out}/profile").collect()]
    assert ["shape", "customer_id", "total_rows", "6000"] in lines
    orphans = spark.read.csv(f"{out}/audit/orphans", header=True).first()
    assert orphans.foreign_key_integrity_status == "PASSED (0 Orphan Records)"
    peak = spark.read.csv(f"{out}/tests/peak", header=True).first()
    assert int(peak.n1) + int(peak.n2) == 5872
    scopes = {r.scope: r for r in spark.read.csv(f"{star}/verify/scenario_verification", header=True).collect()}
    assert int(scopes["non_fraud"].total_txns) == 5872
    kpis = spark.read.csv(f"{out}/reports/query1_executive_overview.csv", header=True).first()
    assert int(kpis.total_transactions) == 6000
