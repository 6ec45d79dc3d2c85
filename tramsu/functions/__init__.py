"""Part of tramsu; see the README for what each module holds."""
