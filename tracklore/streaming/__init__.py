"""Online counterparts: event-time sessions, windows, and bouts that close when their gap has passed."""
