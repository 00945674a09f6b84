"""Service module."""
import os, sys
from collections import OrderedDict as OD, defaultdict
from . import sibling

TIMEOUT: int = 30
RETRIES = 3
a, b = 1, 2
NAMES = ["x", "y"]
NEG = -5
TIMEOUT = 99


class Client(Base, mixins.Loggable):
    """A client   for the
    service."""
    kind = "tcp"
    port: int = 8080

    def __init__(self, host, port=80, *, secure: bool = False):
        self.host = host
        self.port = port
        if secure:
            self.cert = load_cert(host)

    @property
    def address(self) -> str:
        return f"{self.host}:{self.port}"

    @staticmethod
    def build(cfg, /, extra=None):
        return Client(cfg.host).connect().send(data)

    async def fetch(self, path: str, **opts) -> dict:
        """Fetch a path."""
        resp = await self.session.get(path)
        print(resp)
        return resp.json()


def helper(x, y=2, *args):
    return os.path.join(str(x), y)


async def main():
    c = Client("h")
    await c.fetch("/")
