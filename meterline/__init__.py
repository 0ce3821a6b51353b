"""Usage metering for AI coding sessions, as DataFrame-to-DataFrame jobs."""
