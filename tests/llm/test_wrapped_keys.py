"""Keys whose base64 is wrapped, escaped, indented or quoted."""

import base64
import json
import random

from stancepanel.llm import secret_scans


def der(size=607):
    rng = random.Random(size)
    field = lambda tag, b: bytes([tag, 0x82]) + len(b).to_bytes(2, "big") + b
    return field(0x30, b"\x02\x01\x00" + field(0x02, b"\x01" + rng.randbytes(size)) + field(0x02, b"\x01" + rng.randbytes(300)))


def ssh(size=400):
    part = lambda b: len(b).to_bytes(4, "big") + b
    return part(b"ssh-rsa") + part(b"\x01\x00\x01") + part(random.Random(size).randbytes(size))


def lines(data, width=64):
    text = base64.b64encode(data).decode()
    return [text[i:i + width] for i in range(0, len(text), width)]


def pem(data):
    return "\n".join(["-----BEGIN PRIVATE KEY-----", *lines(data), "-----END PRIVATE KEY-----"]) + "\n"


def forms():
    for size in (600, 601, 602, 607, 630):
        data, kind = der(size), "der"
        yield kind, json.dumps({"type": "service_account", "key": pem(data)})
        yield kind, json.dumps(json.dumps({"key": pem(data)}))
        yield kind, json.dumps({"key": pem(data)}).replace("/", "\\/")
        yield kind, "\n".join("    > " + x for x in pem(data).splitlines())
        yield kind, " +\n".join(f'  "{x}\\n"' for x in pem(data).splitlines())
    for kind, data in (("der", der(600)), ("der", der(601)), ("der", der(602)), ("ssh", ssh())):
        yield kind, "the key:\n" + "\n".join(lines(data)) + "\nThe end of it."
        yield kind, "the key:\r\n" + "\r\n".join("\t" + x for x in lines(data, 76)) + "\r\n"
        yield kind, json.dumps({"body": "a\n" + "\n".join(lines(data)) + "\n"})
        yield kind, ",\n".join(f'"{x}"' for x in lines(data))
        yield kind, "\n".join("> " + x for x in lines(data))


def test_wrapped_keys_are_found_and_masked_whole():
    for kind, text in forms():
        assert [k for k, *_ in secret_scans.confirmed(text)] == [kind], text
        left = secret_scans.masked(text)
        longest = max(len(run) for run in secret_scans.LINE.findall(left) or [""])
        assert "[SECRET]" in left and longest < 40, left


def test_key_on_one_line_after_an_escape():
    text = '{"key": "\\n' + base64.b64encode(der()).decode() + '\\n"}'
    (kind, a, b), = secret_scans.confirmed(text)
    assert kind == "der" and text[a:b] == base64.b64encode(der()).decode()


def test_wrapped_text_that_is_no_key_stays():
    data = bytearray(der())
    data[3] ^= 1
    for text in ("\n".join(lines(bytes(data))), "\n".join(lines(random.Random(1).randbytes(3000))),
                 pem(bytes(data)).replace("\n", "\\n")):
        assert not secret_scans.confirmed(text)
