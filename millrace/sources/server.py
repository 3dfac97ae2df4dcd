"""A TCP server of random bits, a line each, to try out socket streams with."""

from __future__ import annotations

import random
import socketserver
import threading
import time


class BitServer:
    """Serves every client its own endless lines "0" and "1", one every so many milliseconds, in threads of its own.

    The n-th client's bits depend on the seed and n alone. Port 0 takes any free one; ``port`` tells which.
    """

    def __init__(self, port: int = 9999, milliseconds: float = 10, seed: int = 42, share_of_ones: float = 0.5):
        stop, clients = threading.Event(), iter(range(10**9))

        class Handler(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                draw = random.Random(f"{seed}:{next(clients)}")
                try:
                    while not stop.is_set():
                        self.wfile.write(b"1\n" if draw.random() < share_of_ones else b"0\n")
                        time.sleep(milliseconds / 1000)
                except OSError:
                    return  # the client has gone

        class Server(socketserver.ThreadingTCPServer):
            allow_reuse_address = True
            daemon_threads = True

        self._server, self._stop = Server(("localhost", port), Handler), stop
        self.port = self._server.server_address[1]

    def __enter__(self) -> BitServer:
        threading.Thread(target=self._server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        self._server.shutdown()
        self._server.server_close()
