"""Small evidence files of one case, built in code."""

from __future__ import annotations

import json
import os

# A warehouse theft: Ines calls Bo and Cem, Bo pays two scrap dealers, a tablet is found with Bo's number.
INES, BO, CEM = "+4915201110001", "+4915201110002", "+4915201110003"
HANDSET, TABLET = "351111222233334", "352222333344445"
DEPOT_IP = "198.51.100.23"


def call_csv() -> str:
    rows = [("2023-11-02 21:40:00", INES, BO, HANDSET), ("02/11/2023 21:55:10", INES, CEM, HANDSET),
            ("", "", "", ""), ("2023-11-02T23:05:00Z", BO, CEM, TABLET), ("03.11.2023 06:30", CEM, INES, "")]
    return "time,Caller,callee,IMEI\n" + "".join(",".join(r) + "\n" for r in rows[:2]) + "-,,,\n" + "".join(
        ",".join(r) + "\n" for r in rows[3:])


def ledger_csv() -> str:
    return ("txn_date,amount,sender account,receiver-account,upi_handle\n"
            '2023-11-03 09:00:00,"INR 1,250.50",DEPOT-7781,BO-SAVINGS,4915201110002@depotbank\n'
            "2023-11-03 09:20:00,700,BO-SAVINGS,SCRAP-EAST,\n"
            "2023-11-03 09:25:00,310.25,BO-SAVINGS,SCRAP-WEST,\n"
            "2023-11-03 10:00:00,9,,NA,\n")


def mail(sender="gate@depot.example", to="ines@post.example", hop=DEPOT_IP) -> str:
    return (f'From: "Gate, Depot" <{sender}>\nTo: <{to}>\nSubject: Ramp 4\n'
            "Date: Thu, 02 Nov 2023 20:15:00 +0100\nMessage-ID: <ramp4@depot.example>\n"
            f"Received: from inner ([127.0.0.1])\n\tby edge (edge [{hop}])\n\tfor <{to}>\n\n"
            "From: nobody@body.example\n")


def device_json() -> str:
    return json.dumps({
        "tablet": {"imei": TABLET, "wifi_mac": "02-aa-bb-cc-dd-01", "last_ip": DEPOT_IP, "note": "he said \"{go\""},
        "sim": {"msisdn": BO}, "apps": [{"app": "org.example.maps"}]}, indent=2)


def write_case(root: str, files: list[tuple[str, str, str | bytes]], case_id: int = 1) -> None:
    """Files as (source type, name, content), with arrival times in list order."""
    for i, (kind, name, content) in enumerate(files):
        folder = os.path.join(root, f"case_id={case_id}", f"source_type={kind}")
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, name)
        with open(path, "wb") as f:
            f.write(content.encode() if isinstance(content, str) else content)
        os.utime(path, (1_710_000_000 + case_id * 100 + i, 1_710_000_000 + case_id * 100 + i))


FOUR = [("cdr", "calls.csv", call_csv()), ("bank_upi", "bank.csv", ledger_csv()),
        ("email", "one.eml", mail()), ("android_log", "dump.json", device_json())]
