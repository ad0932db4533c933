"""Hand-made input tables for quirk tests."""

from __future__ import annotations

import datetime as dt

from cohortlens.sources.fixtures import Sources

SCHEMAS = {
    "employers_dim": "employer_id bigint, registration_date date, country string, city string, "
                     "acquisition_channel string, acquisition_sub_channel string, registration_sub_channel string, "
                     "email string, good_employer int",
    "jobs_dim": "job_id bigint, employer_id bigint, job_posted_date date, good_job int",
    "chats_activity": "employer_id bigint, jobseeker_id bigint, message_date date, employer_messages int",
    "user_balance": "user_id bigint",
    "users": "id bigint, city string",
    "user_balance_history": "id bigint, user_id bigint, balance_change int, created date",
    "user_subscriptions_history": "subscription_id bigint, user_id bigint, name string, created date, test_id int",
    "payment": "id bigint, user_id bigint, purchase_id int, created date",
    "purchases": "id int, sku string",
    "experiment_arms": "product string, test_id int",
    "refs_devices_users": "user_id bigint, device_id bigint",
    "devices": "id bigint, type int",
}

D = dt.date


def employer(eid, reg, country="UK", city="London", channel="Organic", sub="Other", platform="iOS",
             email=None, good=1):
    return (eid, reg, country, city, channel, sub, platform, email or f"e{eid}@mail.example", good)


def make_sources(spark, **tables) -> Sources:
    views = {}
    for name, schema in SCHEMAS.items():
        rows = tables.get(name, [])
        if name == "users" and "users" not in tables:
            rows = [(r[0], "London") for r in tables.get("employers_dim", [])]
        if name == "purchases" and "purchases" not in tables:
            rows = [(0, "app.credits.pack1"), (1, "app.credits.pack1.v2"), (2, "app.credits.pack2"),
                    (3, "app.credits.pack2.v2"), (4, "app.credits.pack3"), (5, "app.credits.pack3.v2"),
                    (6, "app.other")]
        views[name] = spark.createDataFrame(rows, schema)
    return Sources._from_views(views)
