import datetime as dt

import sample_feeds as samples

from feedworks.plans.ddl import create_tables, table_statements
from feedworks.plans.ingest import ingest_members, ingest_redemptions
from feedworks.plans.layout import Layout
from feedworks.plans.profile import VIEW, create_profile_view


def test_catalog_tables_and_view_over_the_stored_layers(spark, root):
    layout = Layout(f"{root}/out")
    day, now = dt.date(2024, 2, 10), dt.datetime(2024, 2, 10)
    samples.write_members(f"{root}/in", *samples.MEMBERS)
    samples.write_feeds(f"{root}/feeds", samples.FEEDS)
    spark.sql("CREATE DATABASE IF NOT EXISTS feeds_db")
    spark.catalog.setCurrentDatabase("feeds_db")
    try:
        create_tables(spark, layout)
        assert spark.table("member_profile_target").isEmpty()
        ingest_members(spark, f"{root}/in", layout, day, now)
        ingest_redemptions(spark, f"{root}/feeds", layout, day, now)
        create_tables(spark, layout)
        create_profile_view(spark)
        counts = {
            name: spark.sql(f"SELECT * FROM {name}").count()
            for name in table_statements(layout)
        }
        assert counts["member_profile_target"] == 6
        assert counts["member_profile_staging"] == 10
        assert counts["member_profile_quarantine"] == 7
        assert counts["redemption_transactions"] == 7
        assert counts["redemption_file_control"] == 10
        view = spark.table(VIEW)
        assert len(view.columns) == 18
        assert view.filter("name IS NULL").count() == 1
        errors = spark.sql(
            "SELECT validation_errors, count(*) AS n FROM member_profile_quarantine "
            "GROUP BY validation_errors ORDER BY n DESC LIMIT 20"
        )
        assert errors.first().n == 2
    finally:
        spark.catalog.setCurrentDatabase("default")
        spark.sql("DROP DATABASE feeds_db CASCADE")
