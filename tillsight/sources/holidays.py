"""The holiday calendar of the retail year."""

# Events with their date ranges, in priority order; where
# ranges overlap, the later event names the day.
HOLIDAYS = (
    ("Eid Al-Fitr Season", (("2024-03-27", "2024-04-10"), ("2025-03-25", "2025-04-05"), ("2026-03-15", "2026-03-30"))),
    ("Eid Al-Adha Season", (("2024-06-02", "2024-06-16"), ("2025-06-01", "2025-06-15"), ("2026-05-20", "2026-06-05"))),
    ("Christmas Season", (("2024-12-11", "2024-12-25"), ("2025-12-15", "2025-12-30"), ("2026-12-15", "2026-12-30"))),
    ("Mother's Day Focus", (("2024-03-15", "2024-03-22"), ("2025-03-15", "2025-03-22"), ("2026-03-10", "2026-03-22"))),
)
