"""Sources that keep coming: facts of files that are new or changed."""
