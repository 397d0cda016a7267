import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strata.schemas import conform  # noqa: E402
from strata.session import build_session  # noqa: E402
from strata.sources.tables import Tables  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
D = dt.date


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[*]", shuffle_partitions=8, driver_memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def mini(spark):
    """The mini-fixture of FIXTURES.md section 3 (edge cases: orphans, NULL keys
    and statuses, id 0, undated and future sessions)."""
    raw = {
        "region": ([(0, "North"), (1, "South")], "region_id long, region_name string"),
        "city": ([(10, "Alpha", 0), (11, "Beta", 1)], "city_id long, city_name string, region_id long"),
        "community": ([(100, "C-A", 10), (101, "C-B", 11)], "community_id long, community_name string, city_id long"),
        "product_type": ([(1, "Elite"), (2, "Youth")], "product_type_id long, product_type_name string"),
        "academy": ([(1000, "AC1", 100, 1), (1001, "AC2", 100, 2), (1002, "AC3", 101, None), (1003, "AC4", None, 2)],
                    "academy_id long, academy_code string, community_id long, product_type_id long"),
        "cohort": ([(1, 1000), (2, 1000), (3, 1001), (4, 1002), (5, 9999)], "cohort_id long, academy_id long"),
        "participant": ([(1, 1, D(2024, 1, 1), "Active"), (2, 1, D(2024, 2, 1), "inactive"), (3, 3, None, "TRUE"),
                         (4, 4, D(2024, 3, 31), " 1"), (5, 5, D(2024, 1, 1), "ACTIVE"), (6, 2, D(2024, 3, 1), None)],
                        "participant_id long, cohort_id long, enrollment_date date, is_active string"),
        "session": ([(1, 1, D(2024, 1, 1), 60), (2, 1, D(2024, 3, 25), None), (3, 3, D(2024, 3, 31), 30),
                     (4, 4, D(2024, 4, 2), 90), (5, 5, D(2024, 3, 30), 45), (6, 2, None, 20)],
                    "session_id long, cohort_id long, session_date date, duration_minutes int"),
        "attendance": ([(1, 1, 1, "Present"), (2, 2, 1, "present"), (3, 2, 2, "absent"), (4, 3, 3, None),
                        (5, 4, 4, "YES"), (6, 5, 5, "TRUE"), (7, 6, 6, "1"), (8, 99, 1, "TRUE"), (9, 2, None, "1")],
                       "attendance_id long, session_id long, participant_id long, attendance_status string"),
        "skill_achievement": ([(1, 1, 7), (2, 1, 8), (3, 3, 7), (4, 5, 9), (5, 6, None)],
                              "skill_achievement_id long, participant_id long, skill_id long"),
        "sport_type": ([], "sport_type_id long, sport_type_name string"),
    }
    frames = {name: conform(spark.createDataFrame(rows, schema), name) for name, (rows, schema) in raw.items()}
    return Tables(frames)
