"""Cases in which an operator once did less than its whole job."""

import math
import re
from collections import Counter


def test_url_filter_counts_all_words(spark):
    """The rarest of 130,000 words splits hosts, the rarest of 110,000 tokens weighs, and words have no longest length."""
    from sparkfacet.llm.url_filter import fit_bayes, segment, with_verdicts

    def name(k):
        return "".join(chr(97 + k // 26**i % 26) for i in range(5))

    common = [name(k) for k in range(130_000)]
    long = "donaudampfschifffahrtselektrizitaeten"
    html = [" ".join([w + " " + w for w in common[k::40]]) for k in range(40)] + [f"zzzzquokka zzzzwombat {long}"]
    urls = [f"http://a.org/{' '.join(common[k:110_000:40])}" for k in range(40)] + ["http://example.org/es/zzzzrare", "http://zzzzquokkazzzzwombat.net/zzzzrare", f"http://{long}zzzzquokka.net/"]
    rows = [(k, u, h) for k, (u, h) in enumerate(zip(urls, html + ["", ""]))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in with_verdicts(pages, fit_bayes(pages)).collect()}
    assert len(got) == len(rows)
    assert got[41].words[:2] == ["zzzzquokka", "zzzzwombat"] and got[42].words[:2] == [long, "zzzzquokka"]
    words = Counter(w for h in html for w in re.findall("[a-z]{2,}", h))
    costs = {w: math.log(sum(words.values()) / n) for w, n in words.items()}
    ruled = {i: "block" if i == 40 else "allow" for i in range(41)}
    counts = {v: Counter() for v in ("block", "allow")}
    for i, v in ruled.items():
        counts[v].update(got[i].words)
        assert got[i].verdict == v
    v = len(counts["block"].keys() | counts["allow"].keys())
    sums = {k: sum(c.values()) for k, c in counts.items()}
    assert "/zzzzrare" in counts["block"] and v > 100_000
    for i in (41, 42):
        assert got[i].words == [w for part in re.findall("[a-z]+", got[i].host) for w in segment(part, costs)] + [f"/{w}" for w in re.findall("[a-z]+", got[i].path)]
        z = math.log(1 / 40) + sum(math.log((counts["block"][t] + 1) / (sums["block"] + v)) - math.log((counts["allow"][t] + 1) / (sums["allow"] + v)) for t in got[i].words if counts["block"][t] or counts["allow"][t])
        assert abs(got[i].p_block - 1 / (1 + math.exp(-z))) < 1e-9


def test_license_lines_and_later_paragraphs(spark):
    """No phrase of the base occurs in any of these."""
    from sparkfacet.llm.license_scan import scan_licenses
    from sparkfacet.llm.license_texts import TEXTS

    def part(label, start, words):
        text = TEXTS[label][0]
        return " ".join(text[text.index(start) :].split()[:words])

    cases = {
        "Licensed under CC BY-NC 4.0.": {"cc-by-nc"}, "Text. Licensed under CC BY 4.0, see above": {"cc-by"}, "Licensed under CC BY-NC-SA 4.0.": {"cc-by-nc-sa"},
        "Released under the Mozilla Public License, version 2.0": {"mpl"}, "Licensed under the BSD 3-Clause License": {"bsd"},
        part("mit", "THE SOFTWARE IS PROVIDED", 60): {"mit", "unlicense"}, part("bsd", "THIS SOFTWARE IS PROVIDED BY", 70): {"bsd"}, part("gpl", "Basic Permissions", 60): {"gpl"},
        part("apache", "Grant of Patent License", 60): {"apache"}, part("mpl", "Fair Use", 40): {"mpl"}, "The weather was good and we went to the sea under the terms of the day": set(),
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: {s.label for s in r.spans} for r in scan_licenses(docs).collect()}
    for k, (text, want) in enumerate(cases.items()):
        assert got[k] >= want and bool(got[k]) == bool(want), (text, got[k], want)


def test_given_license_lines(spark):
    """All four licence lines of the documents are found by spans, the one without a base phrase too."""
    from sparkfacet.llm.queries import op8_license_scan, table

    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache"}
    seen = Counter()
    for r in op8_license_scan(spark, sf).collect():
        for line, label in lines.items():
            if line in text[r.doc_id]:
                assert label in r.labels.split(",") and r.score == 1.0
                seen[label] += 1
    assert seen["cc-by-nc"]
