"""Signal specifications and fixed parameters.

Fixed values (they define scores and labels, so they must stay as written):
  * sample scale 1/200 (raw ADC units to millivolts)
  * online window size 120, 15 windows per streamed frame, 30 per batch frame
  * sliding-window step = window size // 10 (at least 1)
  * training budget 20 % of the sliding windows, dictionary size 10 % of them
  * online anomaly threshold 0.9 (strict ``>``); offline rule is ``>=``
  * threshold sweep: 500 thresholds from 0.0 in steps of 0.0025
  * validation share of the non-training frames 0.4
  * anomaly record keeps the first 60 characters of the payload
  * annotation pattern ``(\\d*:\\d*.\\d*)(\\s*)(\\d*)(\\s*)(\\D)``, groups 1, 3, 5
  * annotation codes: ``N`` is normal, any other code marks the frame abnormal
  * apnea records: 8 bytes, byte 1 equal to 0x20 means ``A``, one record per
    minute of 6000 samples, text line ``%04d, %07d, %02d:%02d, %s``
  * archive path ``yyyy/MM/dd/H/`` (UTC); inspection DC offset 1024/200
  * frame event fields ``srcTs, srcId, frameRef, data, scale``; anomaly record
    fields ``srcId, srcTs, frameRef, maxLoss, timePathRef, dataSlice``
"""

from __future__ import annotations

from dataclasses import dataclass

SCALE = 1 / 200.0
SIGNAL_WINDOW = 120
STREAM_WINDOWS = 15
BATCH_WINDOWS = 30
TRAIN_FRACTION = 0.2
DICT_FRACTION = 0.10
ANOMALY_THRESHOLD = 0.9
SWEEP_START = 0.0
SWEEP_STEP = 0.0025
SWEEP_STEPS = 500
VALIDATION_FRACTION = 0.4
DATA_SLICE_CHARS = 60
ANNOTATION_PATTERN = r"(\d*:\d*.\d*)(\s*)(\d*)(\s*)(\D)"
NORMAL_CODE = "N"
APNEA_MARK = 0x20
APNEA_SAMPLES_PER_MINUTE = 6000
APNEA_LINE_FORMAT = "%04d, %07d, %02d:%02d, %s"
DATE_PATH_FORMAT = "yyyy/MM/dd/H"
DC_OFFSET = 1024 / 200.0
SPLIT_SEED = "split-v1"
SAMPLE_SEED = "sample-v1"


@dataclass(frozen=True)
class SignalSpec:
    """How a driver table is read as a set of sampled signals.

    ``source_col`` identifies a recording, ``value_col`` is the raw sample and
    ``order_cols`` give a unique order of samples inside one recording.
    ``w`` is the window size and ``n`` the number of windows per frame.
    """

    name: str
    table: str
    source_col: str
    value_col: str
    order_cols: tuple[str, ...]
    w: int
    n: int
    scale: float = SCALE

    @property
    def h(self) -> int:
        return self.w // 2

    @property
    def frame_len(self) -> int:
        return self.w * self.n

    @property
    def step(self) -> int:
        return max(1, self.w // 10)

    @property
    def n_windows(self) -> int:
        return 2 * self.n - 1


# Mapping of the driver tables onto signals.
EVENTS = SignalSpec("events", "events", "user_id", "value", ("ts", "event_id"), w=8, n=4)
LINEITEM = SignalSpec(
    "lineitem", "lineitem", "l_suppkey", "l_quantity",
    ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"), w=20, n=5,
)
SIGNALS = {s.name: s for s in (EVENTS, LINEITEM)}
