"""The tagger of personal data: gradients, training, decoding, and the operators."""

import numpy as np
import pytest

from mnemoria.llm.pii import PLACEHOLDERS, find_spans, personal_data_kinds, redact, redact_column, tagger
from mnemoria.llm.pii_train import Batches, Maker, held_out, spans, train
from mnemoria.llm.tagger import KINDS, LABELS, WINDOW, Tagger, encode
from tests.llm.handwritten import score


def test_gradients_are_right():
    model, batch = Tagger(4), next(iter(Batches(1, 3, 20)))
    _, grads = model.gradients(*batch)
    rng = np.random.default_rng(0)
    for name, w in model.weights.items():
        at = tuple(int(rng.integers(0, s)) for s in w.shape)
        if name[0] == "x":
            at = (int(batch[0][3, 0]), 2)
        old, step = w[at], 1e-2
        w[at] = old + step
        up, _ = model.gradients(*batch)
        w[at] = old - step
        down, _ = model.gradients(*batch)
        w[at] = old
        assert (up - down) / (2 * step) == pytest.approx(grads[name][at], rel=0.1, abs=2e-5)


def test_decoding_is_the_best_path():
    model, rng = Tagger(3, seed=5), np.random.default_rng(2)
    scores = [rng.standard_normal((n, LABELS)).astype(np.float32) for n in (1, 4, 3, 4)]
    value = lambda s, p: s[np.arange(len(p)), p].sum() + sum(model.weights["t"][a, b] for a, b in zip(p, p[1:]))
    for s, path in zip(scores, model.decode(scores)):
        every = np.stack(np.meshgrid(*[range(LABELS)] * len(s), indexing="ij"), -1).reshape(-1, len(s))
        assert value(s, path) == pytest.approx(max(value(s, p) for p in every), abs=1e-4)


def test_decoding_apart_is_the_best_path_too():
    rng = np.random.default_rng(3)
    for seed in range(25):
        model = Tagger(3, seed=seed)
        model.weights["t"][:] = rng.standard_normal((LABELS, LABELS)) * rng.choice([0.3, 2, 5])
        scores = [(rng.standard_normal((n, LABELS)) * rng.choice([0.5, 1, 3]) + np.array([rng.choice([0, 2, 5]), 0, 0, 0, 0, 0])).astype(np.float32) for n in (1, 2, 5, 40, 300, 77)]
        assert all((a == b).all() for a, b in zip(model.decode(scores), model.decode_apart(scores)))


def test_a_short_training_learns():
    model = train(steps=60, hidden=8, width=24)
    first, last = (m.gradients(*next(iter(Batches(1, 32, seed=99))))[0] for m in (Tagger(8), model))
    assert last < 0.5 * first


def test_held_out_accuracy_of_the_stored_model():
    for kind, (recall, precision) in held_out(tagger(), 600).items():
        assert recall > 0.95 and precision > 0.9, kind


def test_windows_meet_without_a_seam():
    maker = Maker(31)
    filler = " ".join(maker.plain() for _ in range(40))
    for at in (0, WINDOW - 30, WINDOW - 10, 2 * WINDOW + 7, len(filler)):
        text = filler[:at] + " Call back on +1 617 555 0122 or mail kofi.ostenez@wengohub.example.org now. " + filler[at:]
        got = [(text[a:b], k) for a, b, k in find_spans([text])[0]]
        assert ("+1 617 555 0122", "phone") in got and ("kofi.ostenez@wengohub.example.org", "email") in got


def test_redaction_keeps_the_rest():
    text = "Record of Priya Wenabb: ssn: 000884559. Deliver it to 12 Tarfadak Street, Munneberg."
    found = find_spans([text])[0]
    assert [k for *_, k in found] == ["person_name", "id_number", "street_address"]
    assert redact(text, found) == "Record of [PERSON]: ssn: [ID_NUMBER]. Deliver it to [ADDRESS]."
    for harmless in ("Storm Ivan reached Istkistad.", "Host 192.0.2.17 is slow.", "Copied from node@rack-34.", "Order 000-53-5650 was packed.", "Roadworks on Quadaten Street continue.", "Retry at 1766282345007 failed.", "", " ", "\n", "x"):
        assert find_spans([harmless]) == [[]], harmless
    assert set(PLACEHOLDERS) == set(KINDS) and len(encode("aé́日\n\t٣😀")) == 8 and not spans(np.zeros(3, bool))


def test_pieces_side_by_side_stay_apart():
    cases = {
        "Call 030 23125476, 030 23125477 today.": "Call [PHONE], [PHONE] today.",
        "Reach us on +1 617 555 0122; +1 617 555 0123 or later.": "Reach us on [PHONE]; [PHONE] or later.",
        "tel: 030 23125476/030 23125477": "tel: [PHONE]/[PHONE]",
        "phone 030 23125476 030 23125477 please": "phone [PHONE] [PHONE] please",
        "mail kofi.ostenez@wengohub.example.org, clara.fosann@fosnelab.example now": "mail [EMAIL], [EMAIL] now",
        "Met Priya Wenabb, Clara Fosann at the mill.": "Met [PERSON], [PERSON] at the mill.",
        "Signed off by Bruno Rilobb.\nProf E. Yarikaya can be reached at 0044 20 79460850.": "Signed off by [PERSON].\n[PERSON] can be reached at [PHONE].",
        "Parcel for Anna Lumalow, 2 Ostlewick St., Apt 3, Lumtamere.": "Parcel for [PERSON], [ADDRESS].",
        "Record of Wenabb, Priya: call 030/23125476.": "Record of [PERSON]: call [PHONE].",
    }
    for text, want in cases.items():
        assert redact(text, find_spans([text])[0]) == want


def test_what_the_tagger_finds_is_kept():
    for text, want in {
        "Deliver it to Am Markt 4, Munneberg.": "Deliver it to [ADDRESS].",
        "Deliver it to 12 Station Crescent, Munneberg.": "Deliver it to [ADDRESS].",
        "Deliver it to 10 Park Row, Selwick.": "Deliver it to [ADDRESS].",
    }.items():
        assert redact(text, find_spans([text])[0]) == want

    class Overrun:
        """Labels what stands between braces as a name."""

        def label(self, texts):
            return [np.where((np.cumsum([c in "{}" for c in t]) % 2 == 1), KINDS.index("person_name") + 1, 0) for t in texts]

    for text, want in {"{Priya Wenabb was} here": "{[PERSON] was} here", "so {the Clara Fosann} wrote": "so {the [PERSON]} wrote", "{was at the} mill": "{was at the} mill", "{Priya near the mill} now": "{Priya near the mill} now"}.items():
        assert redact(text, find_spans([text], Overrun())[0]) == want


#: Texts with names, places and sentences that the maker of the training texts doesn't hold, and what is in each.
OUTSIDE = [
    ("Yesterday Siobhan Gallagher phoned about the refund.", "person_name"),
    ("Hi team, Tobias Zimmermann will join us on Monday.", "person_name"),
    ("The parcel was signed for by Oluwaseun Adeyemi at noon.", "person_name"),
    ("Mr. Thistlewood complained twice about the heating.", "person_name"),
    ("Our landlord, Katarzyna Nowakowska, raised the rent.", "person_name"),
    ("Invoice addressed to Guillermo Villanueva.", "person_name"),
    ("Write to gwendolyn.ashcroft@quickparcel.co.uk for help.", "email"),
    ("my new address: tz1987 at webmail dot de", "email"),
    ("User login is m_haddad@unibase.edu since March.", "email"),
    ("Reply-to = sales.lead@bakeryhouse.fr", "email"),
    ("You can text me at +44 7700 900123 after six.", "phone"),
    ("Fax 040-3344556, ask for reception.", "phone"),
    ("Emergency contact phone: (617) 555-0199.", "phone"),
    ("ring 0151 496 0321 tomorrow", "phone"),
    ("We moved to 48 Whitechapel Road, London last spring.", "street_address"),
    ("Send the keys to Kastanienallee 12, 10435 Berlin.", "street_address"),
    ("He lives at 7 rue des Lilas, Lyon.", "street_address"),
    ("Pick me up from 221 Oakwood Drive, Denver.", "street_address"),
    ("The office is at 5 Harbour View, Bristol.", "street_address"),
    ("Her passport number is K84729105.", "id_number"),
    ("SSN 078-05-1120 was on the form.", "id_number"),
    ("His national insurance number: QQ 12 34 56 C.", "id_number"),
    ("ID card no. T22000129 expires soon.", "id_number"),
    ("Hurricane Katrina flooded the lower floors in 2005.", None),
    ("The build took 4815162342 nanoseconds.", None),
    ("Version 2.13.4 ships on 12 May.", None),
    ("Ask the @oncall-bot about ticket 88231177.", None),
    ("Mount Everest is higher than Mont Blanc.", None),
    ("Total 48 boxes on shelf 12, row 7.", None),
    ("The Eiffel Tower opened in 1889.", None),
]


def test_texts_of_another_kind():
    found = {t: {k for *_, k in find_spans([t])[0]} for t, _ in OUTSIDE}
    hits = {k: (sum(k in found[t] for t, want in OUTSIDE if want == k), sum(want == k for _, want in OUTSIDE)) for k in KINDS}
    assert all(n >= 0.75 * of for n, of in hits.values()), hits
    assert sum(bool(found[t]) for t, want in OUTSIDE if want is None) <= 1


def test_sentences_written_by_hand():
    got = score(find_spans)
    # what the README says of them, with a little room
    for kind, (recall, precision) in {"person_name": (0.72, 0.8), "email": (0.85, 0.95), "phone": (0.9, 0.95), "id_number": (0.85, 0.9), "street_address": (0.8, 0.9)}.items():
        assert got[kind][0] >= recall and got[kind][1] >= precision, (kind, got[kind])


def test_operators_on_all_cases(spark):
    mail = "cc clara.fosann(at)fosnelab.example on every draft"
    rows = [("e", 1, mail, "x"), ("e", 1, mail, "x"), ("f", 2, None, "x"), ("g", 3, "", "x"), ("h", 4, "nothing here", "x"), ("i", 5, '{"requester": "Ms Velobb", "tel": "1-415-555-0166"}', "x"), ("j", 6, ("quiet mill. " * 900) + mail, "x")]
    df = spark.createDataFrame(rows, "source string, n int, value string, kinds string")
    got = sorted(map(tuple, personal_data_kinds(df, "value", ["source", "n"]).collect()))
    assert got == [("e", 1, "email"), ("e", 1, "email"), ("i", 5, "person_name"), ("i", 5, "phone"), ("j", 6, "email")]
    out = {r["source"]: r for r in redact_column(df, "value").collect()}
    assert redact_column(df, "value").count() == 7 and redact_column(df, "value").columns == df.columns
    assert out["e"]["value"] == "cc [EMAIL] on every draft" and out["f"]["value"] is None and out["g"]["value"] == "" and out["h"]["value"] == "nothing here" and out["i"]["value"] == '{"requester": "[PERSON]", "tel": "[PHONE]"}' and out["j"]["value"].endswith("cc [EMAIL] on every draft")
    assert personal_data_kinds(df.limit(0), "value", ["n"]).count() == 0 and redact_column(df.limit(0), "value").count() == 0
