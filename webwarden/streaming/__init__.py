"""webwarden.streaming"""
