"""Generated log files of every producer, with made-up values from documentation ranges."""

import gzip
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq


def audit(i=0, **more):
    return {"eventVersion": "1.08", "eventTime": f"2024-03-0{1 + i % 9}T01:02:03Z", "eventSource": "signin.amazonaws.com", "eventName": "ConsoleLogin", "awsRegion": "us-east-1", "sourceIPAddress": f"192.0.2.{i % 250}",
        "userAgent": "cli/1", "recipientAccountId": "000000000000", "userIdentity": {"type": "Root", "arn": "arn:aws:iam::000000000000:root", "sessionContext": {"attributes": {"mfaAuthenticated": "false"}, "sessionIssuer": {"userName": "issuer"}}},
        "responseElements": {"ConsoleLogin": "Success"}, "requestParameters": {"z": 1, "a": {"b": [1, 2]}}, "additionalEventData": {"MFAUsed": "Yes"}, "readOnly": False, "managementEvent": "true", "resources": [{"ARN": "arn:x"}]} | more


def alb(i=0, status="200", method="GET", target="10.0.0.1:80", time=None, extra=True):
    tail = f' "error reason" "-" "-" "Acceptable" "-"' if extra else ""
    return (
        f'https {time or f"2024-03-01T00:00:{i % 60:02d}.123456Z"} app/lb/50dc6c495c0c9188 198.51.100.{i % 250}:2817 {target} 0.000 0.001 -1 {status} {status} 34 366 "{method} https://shop.example:443/p?q={i} HTTP/2.0" "agent/1.0 \\"x\\"" '
        f'TLS_AES TLSv1.3 arn:aws:elasticloadbalancing:eu-west-1:000000000000:targetgroup/t/7 "Root=1-2-3" "shop.example" "session-reused" 0 2024-03-01T00:00:00.000000Z "forward" "-"{tail}'
    )


def waf(i=0, action="BLOCK"):
    return {"timestamp": 1709251200123 + i, "webaclId": "arn:aws:wafv2:us-east-1:000000000000:regional/webacl/w/1", "terminatingRuleId": "SQLiRule", "terminatingRuleType": "REGULAR", "action": action,
        "terminatingRuleMatchDetails": [{"conditionType": "SQL_INJECTION", "location": "URI"}], "httpSourceName": "ALB", "httpSourceId": "s", "responseCodeSent": None,
        "httpRequest": {"clientIp": "203.0.113.7", "country": "NL", "headers": [{"name": "Host", "value": "h.example"}, {"name": "User-Agent", "value": "bot"}], "uri": "/a", "args": "x=1", "httpVersion": "HTTP/1.1", "httpMethod": "POST", "requestId": "r"}, "labels": [{"name": "l"}]}


def apigw(i=0, status="502"):
    return {"request_id": f"q{i}", "ip": "192.0.2.9", "caller": "-", "user": "-", "request_time": "31/Aug/2026:00:00:05 +0000", "http_method": "GET", "resource_path": "/v1", "path": "/v1/x", "status": status, "protocol": "HTTP/1.1",
        "response_length": "12", "integration_status": "200", "integration_latency": "7", "user_agent": "ua", "api_id": "a", "stage": "prod"}


def nginx(i=0, status="503"):
    return {"_source": {"@timestamp": "2026-08-31T00:00:05.120Z", "event": {"dataset": "nginx.access"}, "service": {"name": "web", "environment": "test"}, "trace": {"id": "t"}, "log": {"file": {"path": "/var/log/x"}},
        "birdview": {"request_method": "PUT", "status": status, "client_ip": "192.0.2.1", "remote_addr": "10.0.0.2", "host": "w.example", "request_uri": "/u?x", "http_user_agent": "ua", "http_referer": "-", "server_protocol": "HTTP/1.1", "bytes_sent": 10, "body_bytes_sent": 5, "request_time": 0.5, "upstream_response_time": "0.4"}}}


def write(path, data, members=1):
    raw = data.encode() if isinstance(data, str) else data
    step = -(-len(raw) // members)
    with open(path, "wb") as out:
        for i in range(0, len(raw), step):
            out.write(gzip.compress(raw[i : i + step]))


def lines(rows):
    return "".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows)


def write_folder(root):
    """A folder with a file of each kind and what must be passed over; returns its path."""
    os.makedirs(f"{root}/b/c")
    docs = json.dumps({"Records": [audit(i) for i in range(5)]}) + json.dumps({"note": 1, "Records": [audit(5, errorCode="AccessDenied", eventName="GetObject")]})
    write(f"{root}/a_audit.json.gz", docs, members=3)
    write(f"{root}/b/alb.log.GZ", lines([alb(0), "", "broken line", alb(1, "500"), alb(2, "403", "TRACE"), alb(3, "-", target="-")]))
    write(f"{root}/b/waf.gz", lines([waf(0), waf(1, "ALLOW"), '{"bad']))
    write(f"{root}/b/c/apigw.gz", lines([apigw(0), apigw(1, "200")]))
    write(f"{root}/b/c/nginx.gz", lines([nginx(0), nginx(1, "200")]))
    rows = [{"requestedtimeutc": "2026-08-31 00:00:05.5", "memberid": m, "sourceip": "203.0.113.9, 10.0.0.1", "httpmethod": "GET", "apipath": "/p", "apiparams": None, "requestheaders": '{"user-agent":"app","host":"g.example"}', "requestbody": "", "datadogtraceid": "d"} for m in (0, 42)]
    pq.write_table(pa.Table.from_pylist(rows), f"{root}/gateway.parquet")
    write(f"{root}/digest.gz", json.dumps({"digestPublicKeyFingerprint": "x", "logFiles": []}))
    write(f"{root}/unknown.gz", "nothing of interest")
    with open(f"{root}/fake.gz", "wb") as out:
        out.write(b"this is no gzip stream at all")
    good = gzip.compress(lines([alb(i) for i in range(3000)]).encode())
    with open(f"{root}/truncated.gz", "wb") as out:
        out.write(good[: len(good) // 2])
    for name, data in (("notes.txt", "x"), (".DS_Store", "x"), ("._a.gz", "x"), ("empty.gz", "")):
        with open(f"{root}/{name}", "w") as out:
            out.write(data)
    return root
