import base64
import quopri

from strandline.llm.messages import html_text, paragraphs, part_words, text_parts, words

RU = "Группа из соседнего корпуса будет только в начале следующей недели потому что этикетки были перепутаны"
LONG = "The night run on the second machine was copied to the old folder by mistake last week."


def test_encodings_charsets_and_line_ends():
    for charset in ("windows-1251", "utf-8", "koi8-r"):
        b64 = base64.encodebytes(RU.encode(charset)).decode()
        qp = quopri.encodestring(RU.encode(charset)).decode()
        for enc, body in (("base64", b64), ("QUOTED-PRINTABLE", qp)):
            m = f'From x@y Thu\nSubject: a\nContent-Type: text/plain;\n charset="{charset}"\nContent-Transfer-Encoding: {enc}\n\n{body}'
            for text in (m, m.replace("\n", "\r\n")):
                assert part_words(text) == [words(RU)]


def test_multipart_nesting_attachments_and_broken_input():
    inner = "Content-Type: multipart/alternative; boundary=b2\n\n--b2\n\nplain one\n--b2\nContent-Type: text/html\n\n<p>h<b>t</b>ml &#101;&nbsp;x</p>\n--b2--\n"
    m = f"MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=\"b1\"\n\npreamble\n--b1\n{inner}\n--b1\nContent-Type: text/plain; name=a.txt\nContent-Disposition: attachment; filename=\"a.txt\"\n\nattached\n--b1\nContent-Type: application/octet-stream\nContent-Transfer-Encoding: base64\n\nAAAA\n--b1--\nepilogue"
    assert [(p.is_html, p.attached) for p in text_parts(m)] == [(False, False), (True, False), (False, True)]
    assert part_words(m) == [["plain", "one"], ["html", "e", "x"], ["attached"]]
    assert text_parts(None) == [] and text_parts("") == [] and part_words("no headers here") == [["no", "headers", "here"]]
    assert part_words("Content-Transfer-Encoding: base64\n\n!!!A") == [[]]
    assert part_words("Content-Type: text/plain; charset=nonsense\nContent-Transfer-Encoding: quoted-printable\n\n=E9t=E9 =\nx")[0] == ["été", "x"]
    deep = "Content-Type: message/rfc822\n\n" * 60 + "x: y\n\nbody"
    assert isinstance(part_words(deep), list)


def test_html_rendering():
    assert html_text("<style>a</style><p>a<br>b</p><!-- c --><div>d &lt; e</div>").split() == ["a", "b", "d", "<", "e"]


def test_paragraphs_are_running_text_only():
    m = (
        f"Subject: x\n\nHello all,\n\n> {LONG}\n>\n> > {LONG} Again.\n\n-- \nSome One\nThe Old Office in the West Wing of the House by the Sea\n\n"
        "-----Original Message-----\nFrom: a b c d e f\nSent: one two three four five six seven\nTo: x\n\n526;463;627;609;341;646;731;1;2;3;4;5;6\n\n"
        "[10:40:53] E435 /srv/q5/x14.bin 0x9bd85858 [10:40:53] E435 /srv/q5/x14.bin 0x9bd85858"
    )
    assert paragraphs(m) == [words(LONG), [*words(LONG), "again"]]
    attached = f"Content-Type: text/plain\nContent-Disposition: attachment; filename=a.txt\n\n{LONG}"
    assert paragraphs(attached) == [] and part_words(attached) == [words(LONG)]
    assert len(paragraphs("a: b\n\n" + f"{LONG} " * 20000)) == 1


def test_nesting_of_any_depth():
    inner = "Content-Type: text/plain\n\nthe innermost words"
    for _ in range(60):
        inner = "Content-Type: message/rfc822\n\nSubject: x\n" + inner
    assert [p.text for p in text_parts(inner)] == ["the innermost words"]
    mixed = "Content-Type: text/plain\n\ndeep"
    for i in range(40):
        mixed = f'Content-Type: multipart/mixed; boundary="b{i}x"\n\n--b{i}x\n{mixed}\n--b{i}x\nContent-Type: text/plain\n\nafter {i}\n--b{i}x--\n'
    assert [p.text.strip() for p in text_parts(mixed)] == ["deep", *[f"after {i}" for i in range(40)]]
