"""Write the final (AQE) physical plans of headline keys to docs/plans/.

    python tools/explain_plans.py SF_DIR key [key ...]

Each key is executed once (noop sink) so the adaptive plan is final, then
``explain("formatted")`` text is saved; scratch paths are shortened.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main(argv):
    sf_dir, keys = argv[1], argv[2:]
    from carrylens.plans.catalog import QUERIES
    from carrylens.plans.session import build_session

    spark = build_session(shuffle_partitions=8)
    out_dir = os.path.join(ROOT, "docs", "plans")
    os.makedirs(out_dir, exist_ok=True)
    for k in keys:
        df = QUERIES[k](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = re.sub(r"file:/tmp/[^\]\s,]+", "<scratch>", buf.getvalue())
        with open(os.path.join(out_dir, f"{k}.txt"), "w") as f:
            f.write(f"-- {k} at {sf_dir}\n{text}")
        print(k, len(text))


if __name__ == "__main__":
    main(sys.argv)
