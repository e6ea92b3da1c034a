"""Operator 5 beyond its pools: more values than a format's first forms."""

import re

from tidemill.llm import surrogates


def test_no_original_is_ever_emitted(spark):
    letters = "abcdefghijklmnopqrst"
    persons = [(f"Ж{a}{b}{c}{d}|m", "person") for a in "абвгдежзик" for b in "лмнопрстуф" for c in "абвгдежзик" for d in "лмнопрст"]
    persons += [(f"{n}|m", "person") for n in surrogates.LAST["latin m"]] + [(f"{n}-{m}|m", "person") for n in surrogates.LAST["latin m"] for m in surrogates.LAST["latin m"]]
    phones = [(f"{a}{b}", "phone") for a in "0123456789" for b in "0123456789"]
    mails = [(f"{a}@{b}.de", "email") for a in letters for b in letters]
    given = persons + phones + mails
    got = {r.entity: r.surrogate for r in surrogates.assigned(spark.createDataFrame(given, "entity string, kind string"), "key").collect()}
    assert len(got) == len(set(got.values())) == len(given) > 8000 and not set(got) & set(got.values())
    for entity, new in got.items():
        assert entity not in new, (entity, new)
    for entity, _ in persons:
        assert not set(re.split("[|-]", entity)) & set(re.split("[ -]", got[entity])) and not re.search(r"[0-9]", got[entity])
    for m, _ in mails:
        assert re.fullmatch(r"[0-9]*[a-z]@[a-z]\.de", got[m]) and m[0] != got[m].split("@")[0]


def luhn(digits):
    return sum(sum(divmod(int(d) * (i % 2 + 1), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_formats_scripts_and_mentions(spark):
    given = [
        "иван.петров@mail.example.com and Иван.Петров@mail.example.com", "Mrs Jane Miller came. Jane Miller left; Miller said so, Jane too, MILLER did not.", "Dr Jane Miller", "Dr Γιώργος Παπάς und г-н Ёж Щукин",
        "Call +1 (487) 555-7209 or +1.487.555.7209", "4539 1488 0343 6467 or 4539148803436467", "DE89 3704 0044 0532 0130 00", "Jane@x-ray.org, jane@x-ray.org", "password=abcdefgh1 token: abcdefgh1", "משה.כהן@mail.example.com 山田@mail.example.com",
    ]
    rows = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.replaced(rows, "key").collect()}
    one, two = re.match(r"(\S+) and (\S+)$", got[0].text).groups()
    assert re.fullmatch(r"[а-я]{4}\.[а-я]{6}@[a-z]{4}\.[a-z]{7}\.com", one) and one.split("@")[0] != "иван.петров" and two.lower() == one and two[0].isupper()
    first, last = re.match(r"Mrs (\S+) (\S+) came", got[1].text).groups()
    assert got[1].text == f"Mrs {first} {last} came. {first} {last} left; {last} said so, {first} too, MILLER did not." and got[1].n_entities == 4
    assert got[2].text == f"Dr {first} {last}"
    greek = re.match(r"Dr (\S+) (\S+) und г-н (\S+) (\S+)$", got[3].text).groups()
    assert all("\u0370" <= w[0] <= "\u03ff" for w in greek[:2]) and greek[2] in surrogates.FIRST["cyrillic m"]
    plain = re.match(r"Call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1\.\d{3}\.\d{3}\.\d{4})$|", got[4].text).groups()
    assert len({re.sub(r"\D", "", x) for x in re.split(" or ", got[4].text)}) == 1 and "555" not in got[4].text, (plain, got[4].text)
    cards = got[5].text.split(" or ")
    assert cards[0].replace(" ", "") == cards[1] and luhn(cards[1]) and cards[1] != "4539148803436467"
    iban = got[6].text.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", got[6].text)
    big, small = got[7].text.split(", ")
    assert big.lower() == small and big[0].isupper()
    secret = re.match(r"password=(\w+) token: (\w+)$", got[8].text).groups()
    assert secret[0] == secret[1] != "abcdefgh1"
    assert not set("משהכן山田") <= set(got[9].text) and re.search("[\u0590-\u05ff]", got[9].text) and got[9].n_entities == 2
    clash = rows.withColumn("n_entities", rows.doc_id).withColumn("entity_kinds", rows.text)
    assert {r.text for r in surrogates.replaced(clash, "key").collect()} == {r.text for r in got.values()}


PHONES = [
    "06 12 34 56 78", "+33 6 12 34 56 78", "+49 30 1234567", "030 1234567", "0151 23456789", "01.42.68.53.00", "+49 (0)30 123456-78", "(030) 1234567", "+34 612 345 678",
    "+1 (487) 555-7209", "0151/23456789", "+4915123456789",
]
ADDRESSES = ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1ff:fe23:4567:890a", "2001:db8::8a2e:370:7334", "::1", "fd00::"]


def test_phones_and_addresses_of_more_countries(spark):
    given = [(f"Call {p}, please.", p, "phone") for p in PHONES] + [("Call 0049 30 1234567.", "0049 30 1234567", "card")] + [(f"Host {a} is up", a, "ipv6") for a in ADDRESSES]
    given += [(t, None, None) for t in ("on 01.02.2024 at 08:30", "from 05/11/2023, 0.12345678 of 10:30:45", "std::vector a::b 2024-01-05 07:15", "ratio 1:2", "0 12 apples")]
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(given)], "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.replaced(rows, "key").collect()}
    shape = lambda t: re.sub(r"[0-9]", "9", re.sub("[a-f]", "a", t))
    for i, (text, secret, kind) in enumerate(given):
        r = got[i]
        if secret is None:
            assert r.text == text and r.n_entities == 0, r.text
        else:
            assert r.entity_kinds == [kind] and r.n_entities == 1 and secret not in r.text, r
            before, after = text.split(secret)
            new = r.text[len(before) : len(r.text) - len(after)]
            assert r.text == before + new + after and shape(new) == shape(secret), (secret, new)
