import base64

from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.functions.normalize import alternatives, normalize


def test_separators_and_codes():
    assert normalize("425-71-3482")[0] == "425713482"
    assert normalize("4111 1111 1111 1111")[0] == "4111111111111111"
    assert normalize("%34%31%31%31")[0] == "4111"
    assert normalize("&#52;&#x31;11")[0] == "4111"
    assert normalize("41/**/11")[0] == "4111"
    assert normalize("ip 10.20.30.40 up")[0] == "ip 10.20.30.40 up"
    assert normalize("٤١١١")[0] == "4111"
    assert "secret-value" in normalize("key " + base64.b64encode(b"my secret-value here").decode())[0]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_places_point_into_the_original(text):
    norm, places = normalize(text)
    raw = text.encode("utf-8", "surrogatepass")
    assert len(norm) == len(places)
    assert all(0 <= p < max(len(raw), 1) for p in places)
    assert all(a <= b for a, b in zip(places, places[1:]))


def test_alternatives():
    assert "SOS" in alternatives("... --- ...")
    assert "hello" in alternatives("uryyb")
    assert alternatives("") == []
