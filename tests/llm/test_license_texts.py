"""Sentences as licenses have them, not as rules do: each must be found, alone in its text."""

from braidline.llm import licenses

#: Sentences of public licenses.
SENTENCES = [
    ("cddl", "CDDL v1.0"),
    ("artistic", "You may distribute it under the same terms as Perl itself."),
    ("ofl", "Neither the Font Software nor any of its individual components, in Original or Modified Versions, may be sold by itself."),
    ("ofl", "(c) 2010 A. Author, with Reserved Font Name Example."),
    ("php", "This product includes PHP software, freely available from <http://www.php.net/software/>"),
    ("openssl", "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit"),
    ("openssl", "This product includes cryptographic software written by Eric Young (eay@cryptsoft.com)"),
    ("x11", "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale"),
    ("w3c", "W3C\u00ae liability, trademark and document use rules apply."),
    ("sspl", "If you make the functionality of the Program or a modified version available to third parties as a service, you must make the Service Source Code available"),
    ("sspl", "SSPL-1"),
    ("busl", "Additional Use Grant: none"),
    ("elastic", "You may not provide the software to third parties as a hosted or managed service, where the service provides users with access"),
    ("cc-by-nc", "You may not use the material for commercial purposes."),
    ("cc-by-nd", "If you remix, transform, or build upon the material, you may not distribute the modified material."),
    ("gfdl", "with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."),
    ("json", "The Software shall be used for Good, not Evil."),
    ("mulan", "Mulan PSL v2"),
    ("warranty-disclaimer", "The entire risk as to the quality and performance of the Program is with you."),
    ("liability-limit", "even if advised of the\npossibility of such damage."),
    ("or-later", "or (at your option) any later version."),
    ("noncommercial", "Not for commercial use."),
]


def test_sentences_of_licenses(spark):
    rows = [(i, text) for i, (_, text) in enumerate(SENTENCES)]
    out = {r.doc_id: r.labels.split(",") for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [label for i, (label, _) in enumerate(SENTENCES) if label not in out[i]] == []


def test_sentences_cut_short_are_nothing(spark):
    """What only looks like them stays clean."""
    rows = [(0, "This product includes batteries"), (1, "They sell to third parties as a rule"), (2, "good, not evil"), (3, "a font name"), (4, "at your option, take the bus"), (5, "remix, transform, enjoy")]
    out = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.labels for r in out.collect()] == [""] * 6
