"""webwarden.sources"""
