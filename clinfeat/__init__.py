"""Event tables to one feature row per stay, as DataFrame-to-DataFrame functions."""
