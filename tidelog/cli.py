"""Interactive commands over a store.

    -c NAME                 create a chronicle
    -a CHRONICLE STORY      acquire a story
    -w TEXT                 write an event to the acquired story
    -p N                    its newest N events
    -r START END            its events of a range (nanoseconds, or dates)
    -q CHRONICLE STORY      release a story
    -l [CHRONICLE]          list chronicles, or a chronicle's stories
    -d CHRONICLE [STORY]    destroy
    -disconnect             release all and leave
"""

from __future__ import annotations

import shlex
import sys

from tidelog.api import Store, StoryHandle
from tidelog.errors import EventLogError, NotAcquired
from tidelog.functions.records import parse_time


class Shell:
    def __init__(self, store: Store):
        self.store, self.current = store, None

    def _story(self) -> StoryHandle:
        if self.current is None:
            raise NotAcquired("acquire a story first")
        return self.current

    def run(self, line: str) -> list[str] | None:
        """Lines of output, or None to leave."""
        words = shlex.split(line)
        if not words:
            return []
        command, args = words[0], words[1:]
        if command == "-disconnect":
            self.store.disconnect()
            return None
        if command == "-c":
            self.store.create_chronicle(*args)
        elif command == "-a":
            self.current = self.store.acquire_story(*args)
        elif command == "-w":
            return [str(self._story().log_event(" ".join(args)))]
        elif command == "-p":
            return [f"{r['event_time']} {r['record']}" for r in self._story().playback(int(args[0])).collect()]
        elif command == "-r":
            s = self._story()
            rows = self.store.replay(s.chronicle, s.story, parse_time(args[0]), parse_time(args[1], end=True))
            return [f"{r['event_time']} {r['record']}" for r in rows.toLocalIterator()]
        elif command == "-q":
            self.store.release_story(*args)
            self.current = None
        elif command == "-l":
            return self.store.show_stories(*args) if args else self.store.show_chronicles()
        elif command == "-d":
            (self.store.destroy_story if len(args) > 1 else self.store.destroy_chronicle)(*args)
        else:
            return [__doc__ or ""]
        return ["ok"]


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = argv if argv is not None else sys.argv[1:]
    shell = Shell(Store(SparkSession.builder.appName("tidelog").getOrCreate(), args[0]))
    for line in sys.stdin:
        try:
            out = shell.run(line)
        except (EventLogError, TypeError, IndexError) as e:
            out = [f"{type(e).__name__}: {e}"]
        if out is None:
            break
        print("\n".join(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
