"""Where organism events come from and go to."""
