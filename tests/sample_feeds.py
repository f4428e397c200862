"""Hand-written feeds that tell one story over three days."""

import json
from pathlib import Path

from feedworks.contracts import MEMBER_HEADER

MEMBERS = {
    "members_20240201.txt": [
        MEMBER_HEADER,
        "|D|Nora Quist|200000000001|20190310|20240105|GLD|Ines|WA|USA|19840229|A",
        "|D|Tomas Vale|200000000002|20200612|20231020|SLV|Arun|KA|ind|07041990|A",
        "|D|Ruth Okello|200000000003|20180901|20240110|PLT|Jack|QLD|AUS|19750615|i",
        "|D|Lito Cruz|200000000004|20210115|20240112|SLV|Mila|NCR|PHL|19920930|A",
    ],
    "members_20240202.txt": [
        MEMBER_HEADER,
        "|D|Tomas Vale|200000000002|20200612|20240201|GLD|Arun|KA|IND|07041990|A",
        "|D|Lito Cruz|200000000004|20210115|20240112|SLV|Mila|CA|USA|19920930|A",
        "|D|Dina Rao|200000000005|20240202||SLV|Arun|DL|IND|19991231|",
        "",
        "|H|Some|Other|Header",
        "|D|Too Many|200000000006|20240101||SLV|A|DL|IND|19991231|A|extra",
        "|D|Bad Day|200000000007|20241301||SLV|A|DL|CAN|19991231|Z",
        "|T|4",
    ],
    "members_20240203.txt": [
        MEMBER_HEADER,
        "|D|Nora Quist|200000000001|20190310|20240202|GLD|Ines|WA|USA|19840229|A",
        "|D|Nora Quist|200000000001|20190310|20240202|PLT|Ines|WA|USA|19840229|A",
        '|D|Eve "Q", Jr|200000000008|20240203|20240203|SLV|Ines|WA|USA|19991231|A',
    ],
    "members_bad.txt": [
        "|D|No Date|200000000009|20240101||SLV|A|DL|IND|19991231|A",
    ],
}


def transaction(number, day, status, miles=1000, partner="Hotel"):
    return {
        "txn_id": number, "txn_date": day, "partner": partner,
        "miles_redeemed": miles, "status": status,
    }


def feed(member, day, *transactions):
    return {"member_id": member, "feed_date": day, "redemptions": list(transactions)}


FEEDS = {
    "feed_1.json": feed(
        "200000000001", "20240201",
        transaction("A1", "20240130", "PENDING"),
        transaction("A2", "20240131", "completed "),
    ),
    "feed_2.json": feed(
        "200000000001", "20240202", transaction("A1", "20240130", "COMPLETED", 900)
    ),
    "feed_3.json": feed("200000000099", "20240202", transaction("Z1", "20240201", "PENDING")),
    "feed_empty_array.json": feed("200000000002", "20240202"),
    "feed_wrong_type.json": feed(
        "200000000002", "20240202",
        transaction("B1", "20240201", "PENDING", "many"),
        transaction("B2", "20240201", "PENDING", 5),
    ),
    "feed_bad_member.json": feed(
        "M-1", "20240202", transaction("C1", "20240201", "PENDING"),
        transaction("C2", "20240203", "LOST", -4),
    ),
    "feed_padded_date.json": feed(
        "200000000003", " 20240202", transaction("D1", "20240201", "PENDING")
    ),
    "feed_object.json": {
        "member_id": "200000000003", "feed_date": "20240202", "redemptions": {"txn_id": "E1"},
    },
    "feed_array.json": [
        feed("200000000004", "20240202", transaction("F1", "20240201", "PENDING")),
        feed("200000000005", "20240202", transaction("G1", "20240201", "PENDING")),
    ],
    "feed_number_id.json": feed(
        200000000005, "20240202", transaction("G2", "20240201", "PENDING")
    ),
}
TRUNCATED = '{"member_id": "200000000001", "feed_date": "2024'


def write_members(folder, *names):
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name in names:
        Path(folder, name).write_text("\n".join(MEMBERS[name]) + "\n")


def write_feeds(folder, feeds):
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, content in feeds.items():
        text = content if isinstance(content, str) else json.dumps(content, indent=2)
        Path(folder, name).write_text(text)
