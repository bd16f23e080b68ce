import base64
import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from strandline.functions.regions import Region
from strandline.sources import remote, sequences
from strandline.sources.headers import VcfHeader
from strandline.sources.reserved import definition

SEEN = []


class Stub(BaseHTTPRequestHandler):
    def log_message(self, *a):
        pass

    def _reply(self, body, code=200):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):
        SEEN.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
        if self.path.endswith("absent"):
            return self._reply(json.dumps({"htsget": {"error": "NotFound", "message": "no such id"}}).encode(), 404)
        here = f"http://127.0.0.1:{self.server.server_port}"
        urls = [{"url": "data:application/x;base64," + base64.b64encode(b"one").decode()}, {"url": here + "/block", "headers": {"Range": "bytes=0-2"}}]
        self._reply(json.dumps({"htsget": {"format": "BAM", "urls": urls}}).encode())

    def do_GET(self):
        if self.path == "/block":
            return self._reply(b"two" if self.headers["Range"] == "bytes=0-2" else b"?")
        if self.path.endswith("/metadata"):
            return self._reply(b'{"metadata": {"length": 4}}')
        if self.path.endswith("/service-info"):
            return self._reply(b'{"id": "x"}')
        self._reply(self.path.encode())


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_tickets_and_blocks(spark, url):
    t = remote.ticket(url, "reads", "r1", regions=[Region("sq0", 5, 9), Region("sq1")])
    assert SEEN[-1] == {"format": "BAM", "regions": [{"referenceName": "sq0", "start": 4, "end": 9}, {"referenceName": "sq1"}]}
    assert b"".join(t.chunks()) == b"onetwo"
    assert [bytes(r["data"]) for r in t.frame(spark).orderBy("block").collect()] == [b"one", b"two"]
    remote.ticket(url, "variants", "v", header_only=True, regions=[Region("a")])
    assert SEEN[-1] == {"format": "VCF", "class": "header"}
    with pytest.raises(remote.RemoteError, match="NotFound"):
        remote.ticket(url, "reads", "absent")
    with pytest.raises(ValueError):
        remote.Block("data:text,abc").fetch()


def test_reference_sequences(url):
    assert remote.sequence(url, "abc") == "/sequence/abc" and remote.sequence(url, "abc", 3, 7) == "/sequence/abc?start=2&end=7"
    assert remote.sequence_metadata(url, "abc") == {"length": 4} and remote.service_info(url) == {"id": "x"}


def test_indexed_sequences(spark, tmp_path):
    p = str(tmp_path / "a.fa")
    with open(p, "w") as f:
        f.write(">sq0 d\nACGT\nGGCC\nTT\n>sq1\nAAAA\n")
    index = sequences.index_fasta(p)
    assert sequences.parse_fai(sequences.fai_text(index)) == index == [sequences.FaiRecord("sq0", 10, 7, 4, 5), sequences.FaiRecord("sq1", 4, 25, 4, 5)]
    regions = spark.createDataFrame([("sq0:3-6",), ("sq0:9-99",), ("sq1",), ("sq0:50",)], "region string")
    got = {r["region"]: r["sequence"] for r in sequences.fetch_regions(spark, p, index, regions).collect()}
    assert got == {"sq0:3-6": "GTGG", "sq0:9-99": "TT", "sq1": "AAAA", "sq0:50": ""}
    (tmp_path / "a.fai").write_text(sequences.fai_text(index))
    assert sequences.read_fai(spark, str(tmp_path / "a.fai")).count() == 2
    for bad in (">sq0\nACGT\nACG\nACGT\nAC\n", ">sq0\nACGT\nACGTN\n", ">sq0\nACGT\nACGT\r\nACGT\nAC\n", ">sq0\n"):
        (tmp_path / "b.fa").write_bytes(bad.encode())
        with pytest.raises(ValueError):
            sequences.index_fasta(str(tmp_path / "b.fa"))
    (tmp_path / "a.fq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nAC\n+\nII\n")
    assert sequences.index_fastq(str(tmp_path / "a.fq")) == [("r1", 4, 6, 4, 5, 13), ("r2", 2, 22, 2, 3, 27)]
    (tmp_path / "a.crai").write_bytes(gzip.compress(b"0\t10\t5\t100\t20\t30\n-1\t0\t0\t200\t1\t2\n"))
    (tmp_path / "a.crai").rename(tmp_path / "a.crai.gz")
    assert [tuple(r) for r in sequences.read_crai(spark, str(tmp_path / "a.crai.gz")).orderBy("offset").collect()] == [(0, 10, 5, 100, 20, 30), (None, None, None, 200, 1, 2)]


def test_reserved_definitions():
    assert definition("INFO", (4, 3), "SVLEN") == (".", "Integer") and definition("INFO", (4, 5), "SVLEN") == ("A", "Integer") and definition("INFO", (4, 2), "DP") is None
    assert definition("FORMAT", (4, 5), "LAD") == ("LR", "Integer") and definition("FORMAT", (4, 3), "LAD") is None
    h = VcfHeader.parse("##fileformat=VCFv4.4\n##INFO=<ID=DP,Number=2,Type=Float,Description=\"x\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n")
    assert h.type_of("INFO", "DP") == ("2", "Float") and h.type_of("INFO", "DB") == ("0", "Flag") and h.type_of("INFO", "ZZ") == ("1", "String")
