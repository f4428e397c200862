"""The command line, end to end."""

import pytest
import sample_feeds as samples

from feedworks.jobs import main
from feedworks.plans.layout import Layout


def test_jobs(spark, root, capsys):
    samples.write_members(f"{root}/in", *samples.MEMBERS)
    samples.write_feeds(f"{root}/feeds", samples.FEEDS)
    at = ["--root", f"{root}/out", "--as-of", "2024-02-10"]
    main(["members", "--incoming", f"{root}/in", *at])
    main(["redemptions", "--incoming", f"{root}/feeds", "--skip-whole-check", *at])
    main(["members", "--incoming", f"{root}/in", *at])
    assert "nothing new" in capsys.readouterr().out
    spark.sql("CREATE DATABASE IF NOT EXISTS jobs_db")
    spark.catalog.setCurrentDatabase("jobs_db")
    try:
        main(["tables", *at])
        main(["exports", *at])
        assert "philippines: skipped" in capsys.readouterr().out
        assert spark.table("member_redemption_profile").count() == 7
    finally:
        spark.catalog.setCurrentDatabase("default")
        spark.sql("DROP DATABASE jobs_db CASCADE")
    main(["compact", *at])
    assert "member_profile_target" in capsys.readouterr().out
    main(["reports", *at])
    main(["profile", *at])
    main(["smoke", *at])
    shown = capsys.readouterr().out
    assert "UNSUPPORTED_COUNTRY_CODE" in shown and "Bela" in shown
    assert Layout(f"{root}/out").member_target.read(spark).count() == 6


@pytest.mark.parametrize(
    "job", ["members", "redemptions", "stream-members", "stream-redemptions"]
)
def test_jobs_ask_for_what_they_need(job, root, capsys):
    options = ["--incoming", f"{root}/in"] if job.startswith("stream") else []
    with pytest.raises(SystemExit):
        main([job, "--root", f"{root}/out", *options])
    assert "needs --" in capsys.readouterr().err
