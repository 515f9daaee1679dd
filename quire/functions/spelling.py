"""The shipped spelling rules."""

from __future__ import annotations

# Canonical forms with the variants or expressions that stand for them.
SHIPPED_RULES = (
    {'canonical': 'ke', 'reject': ['keh', 'kay'], 'safe_fix': True, 'regex': '(?i)\\b(?:keh|kay)\\b(?!\\s+(?:dijiye|dijiyega|dena|dete|deti|deta|diya|di|do|dun|doon|den|kar|ke|raha|rahi|rahe|sakta|sakte|sakti|chuka|chuke|chuki|dunga|doonga|lena|gaya|gayi|gaye|rakha|kr))'},
    {'canonical': 'mein', 'reject': ['mei', 'mn', 'mayn'], 'safe_fix': True},
    {'canonical': 'nahi', 'reject': ['nahin', 'nahee', 'nai', 'nhi'], 'safe_fix': True},
    {'canonical': 'yeh', 'reject': ['ye', 'yah'], 'safe_fix': True},
    {'canonical': 'woh', 'reject': ['wo', 'vo', 'voh'], 'safe_fix': True},
    {'canonical': 'kya', 'reject': ['kia', 'kiya?'], 'safe_fix': False},
    {'canonical': 'aur', 'reject': ['our', 'or'], 'safe_fix': False},
    {'canonical': 'liye', 'reject': ['liay', 'liey', 'lye'], 'safe_fix': True},
    {'canonical': 'kyunke', 'reject': ['kyunki', 'kyun ke', 'kyonke', 'kyonki', 'kyunkay'], 'safe_fix': True},
    {'canonical': 'isliye', 'reject': ['is liye', 'isliay', 'is lie'], 'safe_fix': True},
    {'canonical': 'balke', 'reject': ['balkeh', 'balkay', 'bulkay'], 'safe_fix': True},
    {'canonical': 'saath', 'reject': ['sath', 'sathh'], 'safe_fix': True},
    {'canonical': 'jaise', 'reject': ['jese', 'jaisay', 'jaisey'], 'safe_fix': True},
    {'canonical': 'bhi', 'reject': ['bhee', 'bhy'], 'safe_fix': True},
    {'canonical': 'hai', 'reject': ['hay', 'hei', 'hy'], 'safe_fix': False},
    {'canonical': 'hain', 'reject': ['hen', 'hayn', 'hein'], 'safe_fix': False},
    {'canonical': 'tha', 'reject': ['thaa'], 'safe_fix': True},
    {'canonical': 'thi', 'reject': ['thee'], 'safe_fix': False},
    {'canonical': 'chahiye', 'reject': ['chahye', 'chahiay', 'chaheye'], 'safe_fix': True},
    {'canonical': 'Tauheed', 'reject': ['Tawheed', 'Tavheed', 'Tauhid', 'Tawhid', 'Tawheeed'], 'safe_fix': True, 'regex': '\\b(?:Tawheed|Tavheed|Tauhid|Tawhid)\\b'},
    {'canonical': "Ta'ala", 'reject': ["Ta'aala", 'Taala', "Ta'alaa", "Ta'aalaa", 'Taalaa', 'Ta`ala'], 'safe_fix': True, 'regex': "\\bTa['`]?aa?la+\\b(?<!\\bTa'ala)"},
    {'canonical': 'Hadees', 'reject': ['Hadith', 'Hadis', 'Hadeeth', 'Hadeth'], 'safe_fix': True, 'regex': '\\b(?:Hadith|Hadis|Hadeeth|Hadeth)\\b'},
    {'canonical': 'Ibadat', 'reject': ['Ibaadat', 'Ibadah', 'Ibaadah'], 'safe_fix': True, 'regex': '\\b(?:Ibaadat|Ibadah|Ibaadah)\\b'},
    {'canonical': 'Namaz', 'reject': ['Namaaz', 'Nimaz'], 'safe_fix': True, 'regex': '\\b(?:Namaaz|Nimaz)\\b'},
    {'canonical': "Qur'an", 'reject': ['Quran', 'Koran', "Qur'aan", 'Quraan'], 'safe_fix': True, 'regex': "\\b(?:Quran|Koran|Qur'aan|Quraan)\\b"},
    {'canonical': 'Rasoolullah', 'reject': ['Rasulullah', 'Rasool Allah', 'Rasul Allah', 'Rasoolallah', 'Rasulallah'], 'safe_fix': True, 'regex': '\\b(?:Rasulullah|Rasool\\s+Allah|Rasul\\s+Allah|Rasoolallah|Rasulallah)\\b'},
    {'canonical': 'Sallallahu Alaihi Wasallam', 'reject': ['Sallallahu alaihe wa sallam', 'Sallallahu Alaihi wa Sallam', 'Sallallahu alayhi wasallam', 'Sallalahu alaihi wasalam', 'SAW', 'SAWS', 'PBUH', 'S.A.W', 'S.A.W.W'], 'safe_fix': True, 'regex': "\\bsall?all?a+hu\\s+['`]?ala[iy]h[ei]\\s*wa\\s*sall?am\\b(?<!Sallallahu Alaihi Wasallam)|\\(\\s*(?:SAW|SAWS|SAWW|PBUH|S\\.A\\.W\\.?W?\\.?)\\s*\\)"},
    {'canonical': 'Radiallahu Anhu', 'reject': ['Raziallahu anhu', 'raziyallahu anhu', 'Radiyallahu anhu', 'Radhiallahu anhu', 'RA', 'R.A'], 'safe_fix': True, 'regex': "\\bra[dz]h?i?y?all?a+hu\\s+['`]?anhu\\b(?<!Radiallahu Anhu)|\\(\\s*(?:RA|R\\.A\\.?)\\s*\\)"},
    {'canonical': 'Radiallahu Anha', 'reject': ['Raziallahu anha', 'raziyallahu anha', 'Radiyallahu anha', 'Radhiallahu anha'], 'safe_fix': True, 'regex': "\\bra[dz]h?i?y?all?a+hu\\s+['`]?anha\\b(?<!Radiallahu Anha)"},
    {'canonical': 'Radiallahu Anhum', 'reject': ['Raziallahu anhum', 'raziyallahu anhum', 'Radiyallahu anhum', 'Radhiallahu anhum'], 'safe_fix': True, 'regex': "\\bra[dz]h?i?y?all?a+hu\\s+['`]?anhum\\b(?<!Radiallahu Anhum)"},
    {'canonical': 'Radiallahu Anhuma', 'reject': ['Raziallahu anhuma', 'raziyallahu anhuma', 'Radiyallahu anhuma', 'Radhiallahu anhuma'], 'safe_fix': True, 'regex': "\\bra[dz]h?i?y?all?a+hu\\s+['`]?anhuma\\b(?<!Radiallahu Anhuma)"},
    {'canonical': 'Rahimahullah', 'reject': ['Rahimullah', 'rahmatullah alaih', 'rahmatullahi alaih', 'Rahimahullaah', 'RH'], 'safe_fix': False},
    {'canonical': 'Alaihissalam', 'reject': ['alaihi salam', 'alayhis salam', 'alaihis salaam', 'alayhi as-salam', 'alaihi as-salam', '(AS)', 'A.S'], 'safe_fix': True, 'regex': "\\b['`]?ala[iy]h[ei]s?\\s+(?:as[- ])?sal[aā]+m\\b|\\(\\s*(?:AS|A\\.S\\.?)\\s*\\)"},
    {'canonical': 'Aakhirat', 'reject': ['Akhirat', 'Akhirah', 'Aakhirah', 'Akhira'], 'safe_fix': True, 'regex': '\\b(?:Akhirat|Akhirah|Aakhirah|Akhira)\\b'},
    {'canonical': 'Qiyamat', 'reject': ['Qiyamah', 'Qayamat', 'Qiyaamat', 'Qayamah'], 'safe_fix': True, 'regex': '(?<!Al-)(?<!al-)\\b(?:Qiyamah|Qayamat|Qiyaamat|Qayamah)\\b'},
    {'canonical': 'Imaan', 'reject': ['Eman', 'Emaan', 'Iman'], 'safe_fix': False},
    {'canonical': "Bid'at", 'reject': ['Bidat', "Bid'ah", 'Bidah', "Bida'"], 'safe_fix': True, 'regex': "\\b(?:Bidat|Bid'ah|Bidah|Bida')\\b"},
    {'canonical': 'Duniya', 'reject': ['Dunya', 'Dunia', 'Duniyaa'], 'safe_fix': True, 'regex': '\\b(?:Dunya|Dunia|Duniyaa)\\b'},
    {'canonical': 'Jannat', 'reject': ['Jannah', 'Jannath'], 'safe_fix': True, 'regex': '\\b(?:Jannah|Jannath)\\b'},
    {'canonical': 'Ramzan', 'reject': ['Ramadan', 'Ramadhan', 'Ramazan'], 'safe_fix': True, 'regex': '\\b(?:Ramadan|Ramadhan|Ramazan)\\b'},
)
