"""DataFrame-to-DataFrame jobs, keyed so that they scale by case, video or plate."""
