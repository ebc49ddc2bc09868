"""Payloads of audio streams come back byte for byte, whatever words of the format stand in the text."""

import pytest

from bazaarium.llm import mpeg_audio as audio


def back(text):
    n, payload = audio.padded(text)
    media = audio.encode(payload, f"n_bytes={n}")
    return payload, audio.payload_of(media, audio.parse(media))


@pytest.mark.parametrize("word", ["TAG", "ID3", "Xing", "Info", "VBRI"])
def test_words_of_the_format_at_every_offset(word):
    for at in range(6 * audio.UNIT):
        for after in (0, 3):
            payload, got = back("x" * at + word + "y" * after)
            assert got == payload, (word, at, after)


def test_words_of_the_format_before_the_end_of_every_size():
    for units in range(1, 7):
        for before in range(3, 160):
            text = ("x" * (units * audio.UNIT - before) + "TAG").ljust(units * audio.UNIT, "z")
            payload, got = back(text)
            assert got == payload, (units, before)


def test_tag_after_the_frames_is_read_and_after_damage_too():
    payload = bytes(range(32, 127)) * 20
    payload = payload[: len(payload) // audio.UNIT * audio.UNIT]
    media = audio.encode(payload)
    tag = b"TAG" + b"a title".ljust(30, b"\0") + b"an artist".ljust(30, b"\0") + bytes(65)
    for tail in (b"", b"\0" * 50):
        stream = audio.parse(media + tail + tag)
        assert audio.payload_of(media, stream).startswith(payload[:-576])
        assert stream.tags["TIT2"] == "a title"
        assert stream.skipped == len(tail) or tail
    assert audio.payload_of(media, audio.parse(media + tag)) == payload
