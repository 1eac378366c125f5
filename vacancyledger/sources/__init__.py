"""Reading landed captures and tables, extracting postings per platform, writing results."""
